"""DataFrame operators. Input order is explicit (``order`` columns); nothing depends on partition order."""

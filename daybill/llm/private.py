"""Personal data in whole texts: plain identifiers, and disguised ones found through an offset-preserving transducer.

The base pass finds e-mail addresses, IP addresses, card and phone numbers as they stand. The second pass rewrites
homoglyphs, spelled digits and at/dot disguises symbol by symbol, keeping for each output character the source span it
came from, detects on the rewritten text, and maps spans back. A disguised span that touches a base span of its kind is
dropped unless it holds that span and more, so base spans always stay. Offsets are code points, ends exclusive. Every scan is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import slices

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # a long run without dots is one match, not a failure at each digit
GROUP = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Look-alike letters and digits of other scripts, by their plain form.
LOOKALIKES = {
    "a": "аɑα", "c": "сϲ", "e": "еє", "h": "һ", "i": "іι", "j": "ј", "k": "κ", "m": "м", "o": "оοσ", "p": "рρ", "s": "ѕ", "t": "т",
    "v": "ν", "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ",
    "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "@": "＠﹫", ".": "．。｡․", "+": "＋﹢", "-": "－‐‑‒–—−", " ": "\u00a0\u2007\u2009\u202f",
}
# Digits spelled in the languages of the corpus.
NUMERALS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Endings that make a bare "at" or "dot" a disguise rather than a word, general ones and those of countries.
ENDINGS = (
    "com org net edu gov mil int info biz name pro io dev app me tv cloud online site shop blog tech ai co eu "
    "ad ae al am ar at au az ba bd be bg bh bo br by ca ch ci cl cm cn cr cu cy cz de dk do dz ec ee eg es et fi fr ge gh gr gt hk hn hr hu id ie il in iq ir is it "
    "jm jo jp ke kh kr kw kz lb li lk lt lu lv ly ma md mg mk mm mt mu mx my mz na ng ni nl no np nz om pa pe ph pk pl pr pt py qa ro rs ru rw sa sd se sg si sk sn sv sy "
    "th tn tr tw tz ua ug uk us uy uz ve vn ye za zm zw"
).split()
# Words for the two signs of an address.
AT_WORDS, DOT_WORDS = "at|arroba|chez", "dot|punkt|point|punto"

FOLD = {ord(c): plain for plain, others in LOOKALIKES.items() for c in others}
FOLD |= {cp + i: str(i) for cp in (0xFF10, 0x0660, 0x06F0, 0x0966) for i in range(10)}
FOLD |= {0xFF21 + i: chr(65 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
GLYPHS = re.compile("[" + "".join(map(re.escape, map(chr, FOLD))) + "]")


def _boxed(words: str) -> str:
    """A word in brackets, with any blanks in them; runs are possessive, so a scan stays linear."""
    return "(?:" + "|".join(rf"{o}\s*+(?:{words})\s*+{c}" for o, c in ((r"\[", r"\]"), (r"\(", r"\)"), (r"\{", r"\}"), ("<", ">"))) + ")"


_FIRST = r"(?<![\x20\t])[\x20\t]"  # blanks are read from the first of a run on
BOXED_AT, BOXED_DOT = (re.compile(rf"(?i)(?:{_FIRST}*+)?{_boxed(words)}[\x20\t]*+") for words in (AT_WORDS, DOT_WORDS))
_DOT = rf"(?:(?:{_FIRST}*+)?{_boxed(DOT_WORDS)}[\x20\t]*+|{_FIRST}++(?:{DOT_WORDS})[\x20\t]++|\.)"
DOT = re.compile("(?i)" + _DOT)
AT = re.compile(rf"(?i)(?:{_FIRST}*+)?{_boxed(AT_WORDS)}[\x20\t]*+|{_FIRST}++(?:{AT_WORDS}|@)[\x20\t]++|@")
LOCAL_PART, LABEL = frozenset(LOCAL - {"."}), re.compile(r"(?i)[a-z0-9-]++")
SIGN_WORD = re.compile(rf"(?i)(?:{AT_WORDS}|{DOT_WORDS})\Z")
ENDING = re.compile(rf"(?i)(?:{'|'.join(ENDINGS)})\Z")
LETTERS = re.compile(r"(?i)[a-z]{2,}\Z")
SPELLED = re.compile(r"(?i)(?<!\w)(?:" + "|".join(sorted(NUMERALS, key=len, reverse=True)) + r")(?!\w)")
_NUMERAL = "(?:" + "|".join(sorted(NUMERALS, key=len, reverse=True)) + r")(?!\w)"
_PART = rf"(?:[0-9]{{1,3}}|{_NUMERAL}(?:[\x20\t-]{{1,2}}{_NUMERAL}){{0,2}})"  # a part of an IP address has three digits at most
QUAD = re.compile(rf"(?i)(?<![\w.]){_PART}(?:{_DOT}{_PART}){{3}}(?!\w)")
NUMBER = re.compile(rf"(?i)(?<!\w){_NUMERAL}|[0-9]+")
RUN_GAP = re.compile(r"[\x20\t,.-]{1,2}")
HINT = re.compile(rf"(?i)[\[({{<]\s*+(?:{AT_WORDS}|{DOT_WORDS})\s*+[\])}}>]|[\x20\t](?:{DOT_WORDS}|@)[\x20\t]|[\x20\t](?:{AT_WORDS})[\x20\t]++[a-z0-9-]++\.[a-z]")
MIN_SPELLED = 7  # digits in a row, spelled or not, before the spelled ones count as parts of a number
MIN_MIXED = 3  # spelled ones among them, for a phone number that has no plus sign


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, leftmost and non-overlapping within a kind; a match that fails its test is dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found["email"].append((start, end := m.end()))
    if DIGIT.search(text) is None:
        return found
    for m in DOTTED.finditer(text):
        groups = list(GROUP.finditer(text, m.start(), m.end()))
        for i in range(0, len(groups) - 3, 4):
            if all(len(g[0].lstrip("0")) <= 3 and int(g[0].lstrip("0") or 0) <= 255 for g in groups[i : i + 4]):
                found["ip"].append((groups[i].start(), groups[i + 3].end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


def rewrite(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, list[int], list[int]]:
    """The text with ``edits`` applied, and for each output character the start and end of its source."""
    parts, starts, ends, at = [], [], [], 0
    for start, end, plain in edits:
        parts += [text[at:start], plain]
        starts += [*range(at, start), *[start] * len(plain)]
        ends += [*range(at + 1, start + 1), *[end] * len(plain)]
        at = end
    parts.append(text[at:])
    starts += range(at, len(text))
    ends += range(at + 1, len(text) + 1)
    return "".join(parts), starts, ends


def _numerals(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Edits that make each long run of digits, some of them spelled, one run; and the spans of those that are of mixed digits."""
    edits, run, mixtures = [], [], []
    if not SPELLED.search(text):
        return edits, mixtures

    def close() -> None:
        spelled = sum(1 for m in run if m[0].casefold() in NUMERALS)
        total = spelled + sum(len(m[0]) for m in run if m[0].casefold() not in NUMERALS)
        if spelled and total >= MIN_SPELLED:
            for m, after in zip(run, [*run[1:], None]):
                end = after.start() if after else m.end()
                if m[0].casefold() in NUMERALS:
                    edits.append((m.start(), end, NUMERALS[m[0].casefold()]))
                elif after and after[0].casefold() in NUMERALS:
                    edits.append((m.end(), end, ""))
            if spelled < total and spelled >= MIN_MIXED and 9 <= total <= 15:
                mixtures.append((run[0].start(), run[-1].end()))
        run.clear()

    for m in NUMBER.finditer(text):
        if run and not RUN_GAP.fullmatch(text, run[-1].end(), m.start()):
            close()
        run.append(m)
    close()
    return edits, mixtures


def _signs(text: str) -> list[tuple[int, int, str]]:
    """Edits of the signs of addresses, in any mixture of forms and of any length.

    Every sign for "at" is read outwards: to the left over parts of a name and signs for a dot, to the right over labels. No
    other "at" is crossed, so a character is read twice at most.
    """
    edits, done = [], 0
    dots = [m.span() for m in DOT.finditer(text)]
    by_end, by_start = {e: s for s, e in dots}, dict(dots)
    for m in AT.finditer(text):
        # The name: parts joined by dots, back to the end of the address before it.
        signs, at, start = [], m.start(), None
        while True:
            first = at
            while first > done and text[first - 1] in LOCAL_PART:
                first -= 1
            if first == at or SIGN_WORD.match(text, first, at):
                break
            start = first
            if first not in by_end or by_end[first] < done:
                break
            signs.append((by_end[first], first))
            at = by_end[first]
        if start is None:
            continue
        kept = [s for s in signs if s[0] > start]  # a sign with no part before it is not one
        # The domain: labels joined by dots; the longest one with an ending counts.
        steps, at = [], m.end()
        while (label := LABEL.match(text, at)) and not SIGN_WORD.match(text, label.start(), label.end()):
            steps.append(label.span())
            if label.end() not in by_start:
                break
            at = by_start[label.end()]
        bare = text[m.start() : m.end()].strip(" \t")[0] not in "@[({<" or (m.end() - m.start() > 1 and text[m.start() : m.end()].strip(" \t") == "@")
        for n in range(len(steps) - 1, 0, -1):
            sign = text[steps[n - 1][1] : steps[n][0]].strip(" \t")
            known = (sign == "." and bare) or sign[0] not in ".[({<"
            if (ENDING if known else LETTERS).match(text, *steps[n]):
                edits.append((*m.span(), "@"))
                edits += [(*s, ".") for s in kept]
                edits += [(steps[i][1], steps[i + 1][0], ".") for i in range(n)]
                done = steps[n][1]
                break
    return edits


def _quads(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Edits of the dots and spelled parts of IP addresses, and where these are."""
    edits, spans = [], []
    for m in QUAD.finditer(text):
        spans.append(m.span())
        edits += [(*d.span(), ".") for d in DOT.finditer(text, m.start(), m.end())]
        words = list(SPELLED.finditer(text, m.start(), m.end()))
        for w, after in zip(words, [*words[1:], None]):
            end = after.start() if after and re.fullmatch(r"[\x20\t-]{1,2}", text[w.end() : after.start()]) else w.end()
            edits.append((w.start(), end, NUMERALS[w[0].casefold()]))
    return edits, spans


def _within(span: tuple, spans: list[tuple[int, int]]) -> bool:
    """Whether the span touches one of the spans, which are in order and apart."""
    at = bisect_right(spans, (span[0], len(spans) and spans[-1][1])) - 1
    return (at >= 0 and spans[at][1] > span[0]) or (at + 1 < len(spans) and spans[at + 1][0] < span[1])


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the spans, in order, those that touch neither a taken one nor each other; one pass over both lists."""
    out, at, end = [], 0, -1
    joined: list[list[int]] = []
    for s, e in sorted(taken):
        if joined and s < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    for a, b in sorted(spans):
        while at < len(joined) and joined[at][1] <= a:
            at += 1
        if a >= end and not (at < len(joined) and joined[at][0] < b):
            out.append((a, b))
            end = b
    return out


def disguised_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans that only the rewritten text shows, as source spans."""
    folded = text.translate(FOLD) if not text.isascii() and GLYPHS.search(text) else text  # one character for one
    numerals, mixtures = _numerals(folded)
    quads, addresses = _quads(folded) if SPELLED.search(folded) or HINT.search(folded) else ([], [])
    # Digits of an IP address are not one number.
    numerals = [e for e in numerals if not _within(e, addresses)]
    mixtures = [m for m in mixtures if not _within(m, addresses)]
    edits = numerals + quads
    if HINT.search(folded):
        edits += [(*m.span(), "@") for m in BOXED_AT.finditer(folded)] + [(*m.span(), ".") for m in BOXED_DOT.finditer(folded)]
        edits += _signs(folded)
    if not edits and folded is text:
        return {k: [] for k in KINDS}
    edits = sorted(set(edits))
    apart, at = [], 0
    for edit in edits:
        if edit[0] >= at:
            apart.append(edit)
            at = edit[1]
    plain, starts, ends = rewrite(folded, apart) if apart else (folded, range(len(text)), range(1, len(text) + 1))
    out = {k: [(starts[a], ends[b - 1]) for a, b in spans] for k, spans in base_spans(plain).items()}
    # A number of spelled digits, or of enough of them, without a plus sign is a phone number when it has the length of one.
    out["phone"] += _free([*mixtures, *_joined(numerals)], [span for k in KINDS for span in out[k]])
    return out


def _joined(edits: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    spans: list[list[int]] = []
    for start, end, _ in edits:
        if spans and spans[-1][1] == start:
            spans[-1][1:] = [end, spans[-1][2] + 1]
        else:
            spans.append([start, end, 1])
    return [(a, b) for a, b, n in spans if 9 <= n <= 15]


def _wider(spans: list[tuple[int, int]], base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that hold more than the base spans they touch, and those wholly: an address of which the base saw the end."""
    out, at = [], 0
    for a, b in sorted(spans):
        while at < len(base) and base[at][1] <= a:
            at += 1
        inside = at
        while inside < len(base) and base[inside][0] >= a and base[inside][1] <= b:
            inside += 1
        cut = inside < len(base) and base[inside][0] < b
        if inside > at and not cut and (inside - at > 1 or base[at] != (a, b)):
            out.append((a, b))
    return out


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans, each by kind, then start."""
    base = base_spans(text)
    extra = disguised_spans(text)
    added = []
    for kind in KINDS:
        wider = set(_wider(extra[kind], base[kind]))
        free = _free([s for s in extra[kind] if s not in wider], [*base[kind], *wider])
        added += [(kind, a, b) for a, b in sorted([*wider, *free])]
    return [(k, a, b) for k in KINDS for a, b in base[k]], added


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span as a mark of its kind; overlapping spans become one mark, that of the first."""
    parts, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row ``doc_id``, base counts, ``base_sha256``, ``spans`` (base and added) and ``n_added``.

    A null text counts as empty. Rows are independent: repeated rows repeat, extra columns are ignored, an empty table
    gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate(KINDS)}
        line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in slices(batches, "text"):
            counts, sha, spans, extra = {k: [] for k in KINDS}, [], [], []
            for value in batch.column("text").to_pylist():
                base, added = all_spans(value or "")
                for k in KINDS:
                    counts[k].append(sum(1 for s in base if s[0] == k))
                sha.append(hashlib.sha256(line(base).encode()).hexdigest())
                spans.append(line(sorted(base + added, key=lambda s: (order[s[0]], s[1]))))
                extra.append(len(added))
            arrays = [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data in ``text`` replaced by marks; a null text stays null."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = []
            for value in batch.column(at).to_pylist():
                base, added = all_spans(value or "")
                out.append(masked(value, base + added) if base or added else value)
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)

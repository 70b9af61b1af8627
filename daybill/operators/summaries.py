"""Extractive summaries: sentence tables, the best sentence, labelled bundles, repair and version upgrade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import summary
from ..functions.defaults import let, text
from ..functions.regex import all_groups, has
from ..functions.text import strip_markup

GOOD_SCORE = 22


def sentence_table(rows: DataFrame, key: str, source: str, title: str, format: str) -> DataFrame:
    """Narrow table ``(key, pos, s, acceptable, score)``: one row per sentence, never carrying the whole text along."""
    parts = rows.select(
        key, text(title).alias("_t"), text(format).alias("_f"),
        let(strip_markup(source), lambda v: F.struct(summary.merged_sentences(v, F.col(title)).alias("list"), has(v, summary.WHOLE_FAMILY).alias("whole"))).alias("_p"),
    )
    cued = F.transform("_p.list", lambda s: F.struct(s.alias("s"), summary.cue_words(s).alias("cues")))
    exploded = parts.select(key, "_t", "_f", F.col("_p.whole").alias("_whole"), F.posexplode(cued).alias("pos", "_s")).select("*", F.col("_s.s").alias("s"))
    sentence = summary.Cued(F.col("s"), F.col("_s.cues"))
    judged = exploded.withColumn("acceptable", summary.is_acceptable(sentence, F.col("_t"), F.col("_f")))
    return judged.withColumn("score", summary.sentence_score(sentence, F.col("pos"), F.col("_whole"))).select(key, "pos", "s", "acceptable", "score")


def best_sentences(table: DataFrame, key: str) -> DataFrame:
    """``(key, summary, method, quality)`` of the highest scoring acceptable sentence; earlier wins ties."""
    best = table.filter("acceptable").groupBy(key).agg(F.min_by(F.struct("s", "score"), F.struct(-F.col("score"), F.col("pos"))).alias("b"))
    strong = F.col("b.score") >= GOOD_SCORE
    return best.select(
        key, F.col("b.s").alias("summary"), F.when(strong, F.lit("concrete_sentence")).otherwise(F.lit("best_source_sentence")).alias("method"),
        F.when(strong, F.lit("strong")).otherwise(F.lit("acceptable")).alias("quality"),
    )


def labeled_bundle(source: Column, title: Column, format: Column) -> Column:
    """The best run of two or more adjacent ``Label: sentence.`` items, or an empty string.

    Items are found in text order; a run breaks at an unusable item or at text between two items.
    """

    def runs(value: Column) -> Column:
        items = F.zip_with(
            all_groups(value, summary.LABELED_SENTENCE, 0, False),
            F.zip_with(
                all_groups(value, summary.LABELED_SENTENCE, 1, False), all_groups(value, summary.LABELED_SENTENCE, 2, False),
                lambda label, body: F.struct(label.alias("label"), F.trim(body).alias("body")),
            ),
            lambda whole, parts: F.struct(F.trim(whole).alias("whole"), parts["label"].alias("label"), parts["body"].alias("body")),
        )
        start = F.struct(F.lit("").alias("run"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("done"))

        def step(acc: Column, item: Column) -> Column:
            body = item["body"]
            usable = (
                ~has(item["label"], summary.NON_ACTIVITY_LABEL) & ~has(item["whole"], summary.LOGISTICS) & ~summary.is_fragment(body)
                & (has(body, summary.CONCRETE_ACTION) | has(body, summary.DIRECT_ACTION) | has(body, summary.SUPPORT) | has(body, summary.SPECIFIC_OBJECT))
            )
            grown = F.concat_ws(" ", acc["run"], item["whole"])
            adjacent = (acc["n"] > 0) & F.contains(value, grown)
            closed = F.when(acc["n"] >= 2, F.array_append(acc["done"], acc["run"])).otherwise(acc["done"])
            return (
                F.when(usable & adjacent, F.struct(grown.alias("run"), (acc["n"] + 1).alias("n"), acc["done"].alias("done")))
                .when(usable, F.struct(item["whole"].alias("run"), F.lit(1).alias("n"), closed.alias("done")))
                .otherwise(F.struct(F.lit("").alias("run"), F.lit(0).alias("n"), closed.alias("done")))
            )

        return F.aggregate(items, start, step, lambda acc: F.when(acc["n"] >= 2, F.array_append(acc["done"], acc["run"])).otherwise(acc["done"]))

    def best(candidates: Column) -> Column:
        rated = F.transform(
            F.filter(candidates, lambda b: summary.is_acceptable(b, title, format)),
            lambda b, i: F.struct((-F.size(all_groups(b, summary.CONCRETE_ACTION, 0))).alias("a"), (-F.least(F.length(b), F.lit(420))).alias("l"), i.alias("i"), b.alias("b")),
        )
        return F.coalesce(F.array_min(rated)["b"], F.lit(""))

    has_label = F.contains(source, F.lit(":"))
    return F.when(has_label, let(strip_markup(source), lambda v: let(runs(v), best))).otherwise(F.lit(""))


def summary_records(rows: DataFrame, key: str, source: str, title: str, format: str) -> DataFrame:
    """Summary, method, quality, evidence hash and status of every row; rows without a usable sentence need review."""
    bundled = rows.select(key, source, labeled_bundle(F.col(source), text(title), text(format)).alias("_bundle"))
    chosen = best_sentences(sentence_table(rows, key, source, title, format), key)
    raw = strip_markup(source)
    joined = bundled.join(chosen, key, "left")
    with_bundle = F.col("_bundle") != ""
    line = F.when(with_bundle, F.col("_bundle")).otherwise(text("summary"))
    return joined.select(
        key, line.alias("parent_summary"),
        F.when(with_bundle, F.lit("labeled_activity_bundle")).otherwise(F.coalesce("method", F.lit("none"))).alias("summary_method"),
        F.when(with_bundle, F.lit("strong")).otherwise(F.coalesce("quality", F.lit("needs_review"))).alias("summary_quality"),
        F.when(line != "", F.lit("extractive")).otherwise(F.lit("needs_review")).alias("summary_status"),
        F.when(raw != "", F.sha2(raw, 256)).otherwise(F.lit("")).alias("source_description_hash"), F.lit(summary.SUMMARY_VERSION).alias("summary_version"),
    )


def repaired(rows: DataFrame, key: str, current: str, source: str, title: str, format: str) -> DataFrame:
    """Replacement sentences for summaries with issues, and what happens to each row.

    ``disposition`` is ``clean``, ``repaired``, ``unresolved`` or ``excluded``; ``reason`` says why a row is excluded: training for a
    profession, or an over-long summary without a replacement. ``description, age_label, age_source`` count when they are there.
    A replacement is a sentence of the source or its text up to a section heading.
    """
    given = lambda *names: F.concat_ws(" ", *[text(n) for n in names if n in rows.columns])
    content = F.concat_ws(" ", given(title, "description", current, source))
    professional = summary.is_professional_only(content, given("age_label", "age_source"))
    flagged = rows.withColumn("_professional", professional).withColumn("issues", summary.semantic_issues(text(current), F.lit(False)))
    faulty = flagged.filter((F.size("issues") > 0) & ~F.col("_professional"))
    every = sentence_table(faulty, key, source, title, format)
    leads = faulty.select(key, text(title).alias("_t"), text(format).alias("_f"), F.posexplode(summary.heading_lead_ins(strip_markup(source), summary.OVERLONG)).alias("_i", "s"))
    leads = leads.join(every.groupBy(key).agg(F.max("pos").alias("_last")), key, "left").filter(summary.is_acceptable(F.col("s"), F.col("_t"), F.col("_f")))
    behind = leads.select(key, (F.coalesce("_last", F.lit(-1)) + 1 + F.col("_i")).alias("pos"), "s")
    pieces = every.filter("acceptable").select(key, "pos", "s").unionByName(behind)
    candidates = pieces.join(faulty.select(key, current, text(title).alias("_t")), key).filter(
        (F.col("s") != F.col(current)) & (F.length("s") <= summary.OVERLONG) & (F.size(summary.semantic_issues(F.col("s"), F.lit(False))) == 0)
    )
    rated = candidates.withColumn("repair", summary.repair_score(F.col("s"), F.col("pos"), "_t"))
    best = rated.groupBy(key).agg(F.min_by("s", F.struct(-F.col("repair"), F.col("pos"))).alias("replacement"))
    joined = flagged.join(best, key, "left")
    disposition = (
        F.when(F.col("_professional"), F.lit("excluded")).when(F.size("issues") == 0, F.lit("clean")).when(F.col("replacement").isNotNull(), F.lit("repaired"))
        .when(F.array_contains("issues", "overlong_card_summary"), F.lit("excluded")).otherwise(F.lit("unresolved"))
    )
    reason = F.when(F.col("_professional"), F.lit("professional_only")).when(F.col("disposition") == "excluded", F.lit("unrepairable_overlong_summary")).otherwise(F.lit(""))
    told = joined.withColumn("disposition", disposition)
    return told.select(key, "issues", text("replacement").alias("replacement"), "disposition", reason.alias("reason"))


def upgraded(rows: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Adopt the current summary version: extractive rows take the fresh record when it has a summary, verified rows keep their text."""
    joined = rows.join(fresh.select(key, F.col("parent_summary").alias("_new"), F.col("summary_status").alias("_state")), key, "left")
    old = F.col("summary_version") != summary.SUMMARY_VERSION
    extractive = F.col("summary_status") == "extractive"
    renewed = old & extractive & (F.col("_state") == "extractive")
    kept = old & F.col("summary_status").isin("manual_verified", "official_structured")
    return joined.withColumn("parent_summary", F.when(renewed, F.col("_new")).otherwise(F.col("parent_summary"))).withColumn(
        "summary_version", F.when(renewed | kept, F.lit(summary.SUMMARY_VERSION)).otherwise(F.col("summary_version"))
    ).drop("_new", "_state")

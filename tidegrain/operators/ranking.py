"""Scores, demotions and selection of segments.

A ranked table has: group (page), idx (place in the group), kind, heading_path,
text, node_paths (count in ``n_paths``), alignment, and the evidence columns
kind_match, heading_backed, embedded, mean_depth.  Everything is column
expressions and windows over one group, which all share one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.functions import text as T
from tidegrain.functions.values import clamp, findings, given
from tidegrain.runtime import columns_of, map_groups

#: Weight of each kind of segment; others 0.63 (fixed values).
KIND_WEIGHTS = {"paragraph": 0.80, "list_item": 0.74, "table_cell": 0.70, "code": 0.68}
#: Segments of a selection; deep selects all.
PROFILE_LIMITS = {"tiny": 2, "standard": 6, "deep": None}


def _kind_weight(kind: Column) -> Column:
    weight = F.when(kind.isNull(), 0.63)
    for name, value in KIND_WEIGHTS.items():
        weight = weight.when(kind == name, value)
    return weight.otherwise(0.63)


def score(total: Column) -> Column:
    """Kind, heading, place, alignment, length and evidence, from 0 to 1."""
    place = F.when(total > 1, (total - F.col("idx") - 1) / (total - 1) * 0.08).otherwise(0.0)
    shallow = (F.col("mean_depth") > 0) & (F.col("mean_depth") <= 4)
    evidence = given(F.col("kind_match"), 0.05) + given(F.col("heading_backed"), 0.03) + given(F.col("embedded"), 0.10) + given(shallow, 0.02)
    base = _kind_weight(F.col("kind")) + given(F.size("heading_path") > 0, 0.05) + place + F.col("alignment") * 0.18
    return clamp(base + given(F.octet_length("text") > 60, 0.03) + evidence)


def confidence() -> Column:
    """How sure a segment is, at most .99."""
    base = F.lit(0.75) + given(F.col("n_paths") > 0, 0.10) + given(F.size("heading_path") > 0, 0.04)
    return clamp(base + given(F.col("alignment") > 0.45, 0.06) + given(F.octet_length("text") > 40, 0.04), 0.0, 0.99)


def boilerplate_weight(text: Column, depth: Column, paths: Column) -> Column:
    """How much a segment looks like a menu in one line."""
    plain, words = F.trim(text), T.fields(text)
    fits = (plain != "") & (F.octet_length(plain) <= 220) & (F.size(words) >= 5) & (T.marks(plain) == 0) & (depth < 2)
    weight = given(paths >= 4, 0.55) + given(T.mean_length(words, F.octet_length) <= 9, 0.25) + given(T.title_like_share(text) >= 0.7, 0.20)
    return F.when(fits, F.least(weight, F.lit(1.0))).otherwise(0.0)


def _line_mean(text: Column) -> Column:
    return T.mean_length(T.lines(text))


def anchor_weight(text: Column, depth: Column, paths: Column) -> Column:
    """How much a segment explains."""
    return given(F.octet_length(text) >= 140, 0.35) + given(T.marks(text) >= 2, 0.30) + given(paths <= 4, 0.15) + given(depth > 0, 0.10) + given(_line_mean(text) >= 48, 0.15)


def fragment_weight(text: Column, depth: Column, paths: Column, backed: Column) -> Column:
    """How much a segment is a fragment below another."""
    size = F.length(F.trim(text))
    weight = F.when(depth >= 3, 0.40).when(depth == 2, 0.18).otherwise(0.0) + F.when(paths <= 2, 0.25).when(paths <= 4, 0.12).otherwise(0.0)
    weight = weight + given(_line_mean(text) >= 70, 0.15) + given(T.marks(text) <= 2, 0.10) + given(~backed & (depth >= 3), 0.10)
    return F.when(size.between(60, 180), F.least(weight, F.lit(1.0))).otherwise(0.0)


def index_weight(text: Column, depth: Column, paths: Column) -> Column:
    """How much a segment is a list of entries."""
    short = T.share(T.lines(text), lambda x: F.length(x) <= 32)
    weight = F.when(paths >= 8, 0.35).when(paths >= 5, 0.20).otherwise(0.0) + given(short >= 0.65, 0.35) + given(T.marks(text) == 0, 0.15)
    weight = weight + given(_line_mean(text) <= 28, 0.15) + given(depth <= 2, 0.05)
    return F.when((F.trim(text) != "") & (F.octet_length(F.trim(text)) <= 1600), F.least(weight, F.lit(1.0))).otherwise(0.0)


def code_weight(text: Column, paths: Column) -> Column:
    """How much a segment is code."""
    lines = T.lines(text)
    weight = given(T.share(lines, T.identifier_line) >= 0.45, 0.40) + given(T.share(lines, T.symbolic_line) >= 0.50, 0.25) + given(T.marks(text) == 0, 0.10)
    weight = weight + given(_line_mean(text) <= 36, 0.10) + given(paths <= 4, 0.05)
    return F.when((F.trim(text) != "") & (F.octet_length(F.trim(text)) <= 420), F.least(weight, F.lit(1.0))).otherwise(0.0)


def scored(rows: DataFrame, group: str) -> DataFrame:
    """With depth, paths, score and confidence."""
    total = F.count("*").over(Window.partitionBy(group))
    sized = rows.withColumn("depth", F.size("heading_path")).withColumn("n_paths", F.size("node_paths"))
    return sized.withColumn("score", score(total)).withColumn("confidence", confidence())


def _penalized(rows: DataFrame, acts: Column, score_loss: Column, confidence_loss: Column) -> DataFrame:
    lower = F.when(acts, clamp(F.col("score") - score_loss)).otherwise(F.col("score"))
    less = F.when(acts, clamp(F.col("confidence") - confidence_loss, 0.0, 0.99)).otherwise(F.col("confidence"))
    return rows.withColumns({"score": lower, "confidence": less})


def _against_anchor(rows: DataFrame, group: str, weight: Column, least: float, fixed: float, share: float, aligned: bool) -> DataFrame:
    """Demote what has ``weight`` where a strong anchor stands in the group."""
    explains = F.struct(F.col("anchor"), F.col("score"), (-F.col("idx")).alias("i"), F.col("alignment"))
    best = F.max(F.when(F.col("anchor") >= 0.60, explains)).over(Window.partitionBy(group))
    strong = (best["anchor"] >= 0.70) & (best["score"] >= 0.82) & (F.count("*").over(Window.partitionBy(group)) > 1)
    marked = rows.withColumn("_w", weight).withColumn("_best", best).withColumn("_strong", F.coalesce(strong, F.lit(False)))
    acts = F.col("_strong") & (-F.col("idx") != F.col("_best.i")) & (F.col("_w") >= least)
    if aligned:
        acts = acts & ~(F.col("alignment") >= F.col("_best.alignment") + 0.08)
    acts = F.coalesce(acts, F.lit(False))
    return _penalized(marked, acts, F.lit(fixed) + F.col("_w") * share, F.col("_w") * 0.05).drop("_w", "_best", "_strong")


def ranked(rows: DataFrame, group: str) -> DataFrame:
    """Scores after the demotions, which act one after the other: boilerplate,
    fragments, indexes, code; with ``rank`` by score, then place.

    A group is a page.  Its rows meet in one task, so a page is the unit that
    has to fit, not a host or a collection.
    """
    text, depth, paths = F.col("text"), F.col("depth"), F.col("n_paths")
    out = scored(rows, group).withColumn("anchor", anchor_weight(text, depth, paths))
    menu = boilerplate_weight(text, depth, paths)
    out = _penalized(out, menu > 0, menu * 0.28, menu * 0.10)
    out = _against_anchor(out, group, fragment_weight(text, depth, paths, F.col("heading_backed")), 0.60, 0.18, 0.12, False)
    out = _against_anchor(out, group, index_weight(text, depth, paths), 0.55, 0.16, 0.14, True)
    out = _against_anchor(out, group, code_weight(text, paths), 0.55, 0.18, 0.16, True)
    order = Window.partitionBy(group).orderBy(F.desc("score"), "idx")
    return out.withColumn("rank", F.row_number().over(order)).drop("anchor")


def novelty_biased(rows: DataFrame, stable: DataFrame, group: str) -> DataFrame:
    """Score less .05 for known fingerprints and more for new ones, in groups
    that have known ones at all.  ``stable``: group, fingerprint."""
    known = stable.select(group, "fingerprint", F.lit(True).alias("_known")).distinct()
    joined = rows.join(known, [group, "fingerprint"], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    any_known = stable.select(group, F.lit(True).alias("_any")).distinct()
    joined = joined.join(any_known, group, "left")
    bias = F.when(F.col("_any").isNull(), 0.0).when(F.col("_known"), -0.05).otherwise(0.05)
    return joined.withColumn("score", clamp(F.col("score") + bias)).withColumnRenamed("_known", "stable").drop("_any")


def ambiguity() -> Column:
    """How unclear a segment is, from 0 to 1."""
    low = given(F.col("confidence") < 0.78, 0.30) + given(F.col("alignment") < 0.5, 0.28) + given(F.size("heading_path") == 0, 0.10)
    return clamp(low + given(F.octet_length("text") < 48, 0.12) + given(F.col("score") < 0.75, 0.10))


def lane(unclear: Column, profile: str) -> Column:
    """The lane of treatment, 0 to 3, that a segment calls for."""
    loss = 1 - F.col("alignment")
    base = F.when((unclear >= 0.85) | ((loss >= 0.90) & (F.col("confidence") < 0.70)), 2).when((unclear > 0.37) | (loss > 0.15), 1).otherwise(0)
    if profile != "tiny":
        return base
    return F.when((base >= 2) | (unclear >= 0.60), 3).otherwise(base)


def risk_flags(unclear: Column) -> Column:
    return findings(
        (1 - F.col("alignment") > 0.50, "coverage_gap"), (unclear > 0.50, "high_ambiguity"), (F.size("heading_path") == 0, "missing_heading_context"), (F.octet_length("text") < 48, "short_segment"),
    )


#: Flags (fixed values) that never let a row settle a group, and that make a row
#: unclear.
STRICT_RISK = ["high_ambiguity", "coverage_gap"]
UNCLEAR_FLAGS = ["high_ambiguity", "coverage_gap", "short_text", "low_confidence"]


def ambiguity_routes(rows: DataFrame, group: str, substrate: Column | None = None) -> DataFrame:
    """The rows of each group that a further look is asked for, of groups that
    need one.

    ``rows``: the group, rank, score, confidence, heading_path, kind_match,
    heading_backed, embedded, lane and flags; ``substrate`` is what the page is
    built with.  A group needs no look if its first row stands out (anchor or
    dominance), if one row is sure enough, if it carries a payload, or if fewer
    than two rows are unclear.
    """
    built = F.lit("generic_content") if substrate is None else substrate
    evident = F.col("heading_backed") | F.col("kind_match") | F.col("embedded") | (F.size("heading_path") > 0)
    strict = F.arrays_overlap("flags", F.array(*(F.lit(x) for x in STRICT_RISK)))
    known = rows.withColumn("_strict", strict).withColumn("_evident", evident).withColumn("_theme", built == "theme_heavy_wordpress").withColumn("_payload", built == "embedded_app_payload")
    whole = Window.partitionBy(group)
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).over(whole)
    any_of = lambda c: F.coalesce(F.max(c).over(whole), F.lit(False))
    rest, score, confidence = F.col("rank") > 1, F.col("score"), F.col("confidence")
    known = known.withColumn("_top", first("score")).withColumn("_sure", first("confidence")).withColumn("_many", F.count("*").over(whole))
    lead = lambda least, other: any_of((F.col("rank") == 1) & (confidence >= least) & (score >= other) & F.col("_evident") & ~F.col("_strict"))
    anchored = lead(0.88, 0.90) & ~any_of(rest & F.col("_strict"))
    rival = rest & ((F.col("_evident") & (score >= F.col("_top") - 0.05) & (confidence >= F.col("_sure") - 0.05)) | (F.col("_strict") & (score >= F.col("_top") - 0.08)))
    enough = F.when(F.col("_theme"), 0.82).otherwise(0.86)
    resolved = any_of((confidence >= enough) & (score >= enough) & F.col("_evident") & ~F.col("_strict"))
    unclear = (confidence < 0.80) | (score < 0.84) | F.arrays_overlap("flags", F.array(*(F.lit(x) for x in UNCLEAR_FLAGS))) | ((F.col("lane") >= 1) & F.col("_strict"))
    known = known.withColumn("_ask", unclear & (~F.col("_theme") | F.col("_strict"))).withColumn("_settled", anchored | (lead(0.90, 0.92) & ~any_of(rival)) | F.col("_payload") | resolved)
    asked = known.withColumn("_asked", F.count_if(F.col("_ask")).over(whole))
    return asked.where("NOT _settled AND _ask AND _asked >= 2").select(*rows.columns)


def page_class(url: Column) -> Column:
    lower = F.lower(url)
    return F.when(lower.contains("forum") | lower.contains("thread"), "forum").when(lower.contains("api") | lower.contains("docs"), "docs").otherwise("article")


def selected(rows: DataFrame, profile: str = "standard") -> DataFrame:
    """The first rows of each group that a profile takes."""
    limit = PROFILE_LIMITS[profile]
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def near_same(candidate: str, kept: str) -> bool:
    """Equal, or one begins or ends with the other of 40 bytes or more and 70 %."""
    if candidate == kept:
        return True
    short, long = sorted((candidate, kept), key=lambda x: len(x.encode()))
    fits = len(short.encode()) >= 40 and len(short.encode()) >= 0.70 * len(long.encode())
    return fits and (long.startswith(short) or long.endswith(short))


def deduplicated(rows: DataFrame, group: str) -> DataFrame:
    """Without rows that are nearly the same as one before them by rank.

    Greedy, so by group in Python; a group is the selection of one page.  A new
    row takes the place of a stable one it repeats (column ``stable``).
    """

    def run(page: list[dict]) -> list[dict]:
        kept: list[dict] = []
        norms: list[str] = []
        page.sort(key=lambda r: r["rank"])
        for row in page:
            norm = " ".join((row["text"] or "").lower().split())
            if not norm:
                continue
            at = next((i for i, k in enumerate(norms) if near_same(norm, k)), None)
            if at is None:
                kept.append(row)
                norms.append(norm)
            elif kept[at]["stable"] and not row["stable"]:
                kept[at], norms[at] = row, norm
        return kept or page[:1]

    return map_groups(rows, group, run, columns_of(rows))


def policy_selected(candidates: DataFrame, group: str, limit: int = 6, profile: str = "standard") -> DataFrame:
    """The first ``limit`` of each group, where the last without it gives way to
    the best embedded row (pages with payload), the best heading-backed row
    (heading_ratio .15 or more) and a weak row to a stronger one (short_ratio
    .80 or more, not in the deep profile).  Needs the page's signals as columns."""

    def run(page: list[dict]) -> list[dict]:
        rows = sorted(page, key=lambda r: r["rank"])
        chosen, rest = rows[:limit], rows[limit:]

        def swap(has: str) -> None:
            if any(r[has] for r in chosen):
                return
            better = next((r for r in rest if r[has]), None)
            if better is not None:
                rest.remove(better)
                chosen[-1] = better

        if rows and rows[0]["embedded_count"] > 0:
            swap("embedded")
        if rows and rows[0]["heading_ratio"] >= 0.15:
            swap("heading_backed")
        if rows and rows[0]["short_text_ratio"] >= 0.80 and profile != "deep":
            weak = next((i for i in range(len(chosen) - 1, -1, -1) if len((chosen[i]["text"] or "").strip().encode()) < 40 and not (chosen[i]["heading_backed"] or chosen[i]["embedded"] or chosen[i]["kind_match"])), None)
            strong = next((r for r in rest if r["heading_backed"] or r["embedded"] or r["kind_match"] or len((r["text"] or "").strip().encode()) >= 80), None)
            if weak is not None and strong is not None:
                chosen[weak] = strong
        return chosen

    return map_groups(candidates, group, run, columns_of(candidates))


def utility(text: Column, depth: Column) -> Column:
    """How useful a chunk is to show, from 0 to 1."""
    plain = T.display(text)
    size, n = F.length(plain), T.marks(plain)
    words = T.fields(plain)
    by_size = F.when(size.between(180, 700), 0.42).when(size >= 100, 0.28).when(size >= 60, 0.16).otherwise(0.06)
    by_depth = F.when(depth == 0, 0.02).when(depth == 1, 0.14).when(depth == 2, 0.08).otherwise(0.02)
    menu = (n == 0) & (depth <= 1) & size.between(60, 180) & (F.size(words) >= 8) & (T.mean_length(words) <= 10)
    weight = by_size + by_depth + F.when(n >= 2, 0.20).when(n == 1, 0.12).otherwise(0.0) + given(size >= 48, 0.10) - given((depth >= 3) & (size <= 180), 0.22) - given(menu, 0.26)
    return F.when(plain == "", 0.0).otherwise(clamp(weight))


def uncertainty(confidence: Column, heading_ratio: Column, short_ratio: Column, embedded: Column) -> Column:
    """The reasons to doubt a packet."""
    return findings(
        ((confidence > 0) & (confidence < 0.72), "low_top_chunk_confidence"), ((confidence >= 0.72) & (confidence < 0.84), "moderate_top_chunk_confidence"), ((heading_ratio > 0) & (heading_ratio < 0.12), "weak_heading_structure"),
        (short_ratio >= 0.88, "fragmented_page_surface"), (embedded >= 12, "embedded_heavy_surface"),
    )


def level(reasons: Column) -> Column:
    return F.when(F.size(reasons) == 0, "low").when(F.size(reasons) <= 2, "medium").otherwise("high")


def outline(paths: Column) -> Column:
    """Distinct labels of heading paths, in order: up to the last two parts of
    each heading's breadcrumbs, repeats left out."""

    def label(path: Column) -> Column:
        pieces = F.transform(path, lambda h: F.reverse(F.slice(F.reverse(F.filter(F.transform(F.split(h, ">"), T.one_line), lambda x: x != "")), 1, 2)))
        flat = F.flatten(pieces)
        once = F.filter(flat, lambda x, i: (i == 0) | (x != F.get(flat, i - 1)))
        return F.array_join(once, " > ")

    return F.array_distinct(F.filter(F.transform(paths, label), lambda x: x != ""))


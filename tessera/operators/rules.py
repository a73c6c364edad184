"""Grades: conclusions, authority between layers, and resolution of matched rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grades from best to worst, and spellings that stand for one of them.
GRADES = ("S", "A", "B", "C", "D", "E", "F", "X")
ALIASES = {"AA": "S"}


def grade(text: Column, *, aliases: dict[str, str] = ALIASES) -> Column:
    """A grade's letter, or the empty text."""
    up = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    for other, real in aliases.items():
        up = F.when(up == other, real).otherwise(up)
    return F.when(up.isin(*GRADES), up).otherwise("")


def rank(letter: Column) -> Column:
    """Place from 1 (best) to 8, null for anything else."""
    return F.nullif(F.array_position(F.array(*[F.lit(g) for g in GRADES]), letter), F.lit(0))


def _answer(said: Column) -> Column:
    """Mode, grade and issues by what was said."""
    core, best, likely, worst, given, mode = (said[c] for c in ("core", "best", "likely", "worst", "given", "mode"))
    legal_letters = sum((F.when(g != "", 1).otherwise(0) for g in (best, likely, worst)), F.lit(0))
    complete = (best != "") & (likely != "") & (worst != "")
    ordered = complete & F.coalesce((said["rank_best"] <= said["rank_likely"]) & (said["rank_likely"] <= said["rank_worst"]), F.lit(False))
    equal = ordered & (best == worst)
    machine_x = (core == "X") | (best == "X") | (likely == "X") | (worst == "X")
    mismatch = (core != "") & (core != likely)
    none = F.lit(None).cast("string")
    # (condition, mode, grade, issues): the first row whose condition holds is the answer.
    no = F.array().cast("array<string>")
    issue = lambda *names: F.array_compact(F.array(*[n if isinstance(n, Column) else F.lit(n) for n in names]))
    likely_issue = issue(F.when(mismatch, "core_likely_mismatch"))
    table = [
        ((mode == "blocked") | F.coalesce(F.col("blocked"), F.lit(False)), "blocked", none, no),
        (mode == "labels_only", "labels_only", none, no),
        ((mode == "bounded_range") & machine_x, "labels_only", none, issue("machine_x_not_allowed")),
        ((mode == "bounded_range") & ordered & ~equal, "bounded_range", none, likely_issue),
        (mode == "bounded_range", "labels_only", none, issue(F.when(complete, "bounded_range_not_distinct").otherwise("invalid_bounded_range"))),
        ((mode == "fixed_grade") & machine_x, "labels_only", none, issue("machine_x_not_allowed")),
        ((mode == "fixed_grade") & (core == ""), "labels_only", none, issue("invalid_fixed_grade")),
        ((mode == "fixed_grade") & ((given != 3) | ~complete), "labels_only", none, issue("incomplete_fixed_grade_range")),
        ((mode == "fixed_grade") & (~equal | mismatch), "labels_only", none, issue("fixed_grade_conflict")),
        (mode == "fixed_grade", "fixed_grade", core, no),
        ((given > 0) & ~complete, "labels_only", none, issue("missing_range_grade", F.when(legal_letters != given, "invalid_range_grade"))),
        (complete & ~ordered, "labels_only", none, issue("range_order_invalid")),
        (ordered & ~equal, "bounded_range", none, likely_issue),
        (equal & mismatch, "labels_only", none, issue("fixed_grade_conflict")),
        (equal, "fixed_grade", likely, no),
        (core != "", "fixed_grade", core, no),
        ((F.coalesce(F.col("labels"), F.lit(0)) > 0) | (F.coalesce(F.col("unresolved"), F.lit(0)) > 0), "labels_only", none, no),
    ]
    answer = lambda m, g, i: F.struct((m if isinstance(m, Column) else F.lit(m)).alias("mode"), g.alias("grade"), i.alias("issues"))
    return reduce(lambda rest, row: F.when(row[0], answer(*row[1:])).otherwise(rest), reversed(table), answer("unscanned", none, no))


def conclusions(rows: DataFrame) -> DataFrame:
    """Mode, grade and issues of each conclusion.

    Reads core, best, likely, worst (grades as written), mode, blocked, labels and unresolved
    (counts), review (boolean), queue and insufficient (boolean); adds ``conclusion_mode``,
    ``fixed_grade``, ``issues`` and ``pending`` (arrays).  An explicit mode is held to its own
    conditions and falls back to labels with an issue; without one the range decides, then the core
    grade, then whether there is anything else to show.
    """
    letters = [grade(F.col(c)).alias(c) for c in ("core", "best", "likely", "worst")]
    given = sum((F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", 1).otherwise(0) for c in ("best", "likely", "worst")), F.lit(0))
    said = F.struct(*letters, *[rank(x).alias(f"rank_{c}") for c, x in zip(("core", "best", "likely", "worst"), letters, strict=True)], given.alias("given"), F.lower(F.trim(F.coalesce(F.col("mode"), F.lit("")))).alias("mode"))
    # Bound to a name, so that each letter is found once and not in every branch that reads it.
    picked = F.transform(F.array(said), _answer)[0]
    pending = {
        "bounded_range": F.col("conclusion_mode") == "bounded_range",
        "requires_human_review": F.coalesce(F.col("review"), F.lit(False)),
        "unresolved_dimensions": F.coalesce(F.col("unresolved"), F.lit(0)) > 0,
        "more_research": F.lower(F.trim(F.coalesce(F.col("queue"), F.lit("")))) == "more_research",
        "insufficient_coverage": F.coalesce(F.col("insufficient"), F.lit(False)),
    }
    out = rows.withColumn("picked", picked)
    out = out.select(*rows.columns, F.col("picked.mode").alias("conclusion_mode"), F.coalesce("picked.grade", F.lit("")).alias("fixed_grade"), F.col("picked.issues").alias("issues"))
    return out.withColumn("pending", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in pending.items()])))


def strict_conclusions(rows: DataFrame) -> DataFrame:
    """The reader's own normaliser: no aliases, a range needs core = likely and may be equal throughout.

    Adds ``valid`` and ``reason``; kept apart from ``conclusions``, with which it disagrees.
    """
    core, best, likely, worst = (grade(F.col(c), aliases={}) for c in ("core", "best", "likely", "worst"))
    complete = (best != "") & (likely != "") & (worst != "")
    ordered = complete & F.coalesce((rank(best) <= rank(likely)) & (rank(likely) <= rank(worst)), F.lit(False))
    mode = F.lower(F.trim(F.coalesce(F.col("mode"), F.lit(""))))
    reason = (
        F.when(~mode.isin("fixed_grade", "bounded_range"), "unknown_mode")
        .when(core == "", "no_core_grade")
        .when(mode == "fixed_grade", F.when(complete & ~(ordered & (best == worst)), "range_not_fixed"))
        .when(~ordered, "range_invalid")
        .when(core != likely, "core_not_likely")
    )
    return rows.withColumn("valid", reason.isNull()).withColumn("reason", reason)


def effective_grade(rows: DataFrame) -> DataFrame:
    """The grade that a catalog shows, with its ``source`` and whether people ``reviewed`` it.

    Reads human_grade, human_status, review_status, notice, stored, suggested and researched.  A human
    grade that is not pending comes first, then the stored grade of reviewed rows, a suggestion,
    research (which shows no grade) and the stored grade as a legacy suggestion.  S reads AA; what is
    no grade is ``unknown``.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))

    def shown(c: str) -> Column:
        letter = grade(F.col(c))
        return F.when(letter == "S", "AA").when(letter == "", "unknown").otherwise(letter)

    human = (text("human_grade") != "") & (text("human_status") != "pending")
    reviewed = human | F.coalesce(F.col("review_status") == "reviewed", F.lit(False)) | F.coalesce(F.col("notice") == "manual_reviewed", F.lit(False))
    answer = lambda g, s: F.struct(g.alias("grade"), F.lit(s).alias("source"))
    picked = (
        F.when(human, answer(shown("human_grade"), "human")).when(reviewed, answer(shown("stored"), "human"))
        .when(shown("suggested") != "unknown", answer(shown("suggested"), "ai")).when(shown("researched") != "unknown", answer(F.lit("unknown"), "research"))
        .when(shown("stored") != "unknown", answer(shown("stored"), "ai_legacy")).otherwise(answer(F.lit("unknown"), "unassessed"))
    )
    return rows.withColumn("shown_grade", picked).select(*rows.columns, "shown_grade.grade", "shown_grade.source", reviewed.alias("reviewed"))


def authority(rows: DataFrame, layers: list[tuple[str, Column, Column]]) -> DataFrame:
    """The first layer that may speak, as ``layer`` and ``value``; else unassessed."""
    found = F.coalesce(*[F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("layer"), value.cast("string").alias("value"))) for name, ok, value in layers])
    return rows.withColumn("found_layer", found).select(*rows.columns, F.coalesce("found_layer.layer", F.lit("unassessed")).alias("layer"), F.col("found_layer.value").alias("value"))


def presence_first(rows: DataFrame, layers: list[tuple[str, Column, Column]]) -> DataFrame:
    """The highest layer that is present decides, valid or not: a malformed one blocks those below.

    Layers are (name, present, valid); adds ``bucket`` (the layer, blocked_<layer> or unassessed).
    """
    out = F.lit("unassessed")
    for name, present, valid in reversed(layers):
        out = F.when(F.coalesce(present, F.lit(False)), F.when(F.coalesce(valid, F.lit(False)), name).otherwise(f"blocked_{name}")).otherwise(out)
    return rows.withColumn("bucket", out)


def resolve(rows: DataFrame, *, severity: tuple[str, ...], positive: tuple[str, ...], strong: tuple[str, ...], contradictions: dict[str, tuple[str, str]], least: float = 0.5, coverage: float = 0.5, fallback: tuple[str, str] = ("D", "D-UNCLEAR")) -> DataFrame:
    """The decisive rule of each row: worst grade, then confidence, then code.

    Reads ``rules`` (array of code, grade, matched, confidence, status), ``evidence_coverage``,
    ``evidence_status`` and ``protected``.  Without a match, or where only positive grades match on
    thin and weak evidence, an unclear fallback joins in.  Adds ``decisive_code``,
    ``decisive_grade``, ``confidence``, ``contradictions`` and ``plan_status``.
    """
    order = F.create_map(*[x for i, g in enumerate(severity) for x in (F.lit(g), F.lit(i))])
    entry = lambda g, c, conf, code, status: F.struct(order[g].alias("severity"), (-conf).alias("less_sure"), code.alias("code"), g.alias("grade"), c.alias("confidence"), status.alias("status"))
    matched = F.array_sort(F.transform(F.filter(F.coalesce("rules", F.array().cast("array<struct<code:string,grade:string,matched:boolean,confidence:double,status:string>>")), lambda r: F.coalesce(r["matched"], F.lit(False)) & (r["confidence"] >= least)), lambda r: entry(r["grade"], r["confidence"], r["confidence"], r["code"], r["status"])))
    base = rows.withColumn("hits", matched)
    share = F.coalesce("evidence_coverage", F.lit(0.0))
    status = F.coalesce("evidence_status", F.lit("insufficient_evidence"))
    unclear = lambda c: entry(F.lit(fallback[0]), c, c, F.lit(fallback[1]), F.lit("insufficient_evidence"))
    none = F.size("hits") == 0
    weak = ~status.isin(*strong) & ~F.exists("hits", lambda r: F.coalesce(r["status"].isin(*strong), F.lit(False)))
    thin = ~none & F.col("hits")[0]["grade"].isin(*positive) & (share < coverage) & weak
    hits = F.when(none, F.array(unclear(F.when(share < 0.2, 0.95).otherwise(0.75)))).when(thin, F.array_sort(F.concat("hits", F.array(unclear(F.greatest(F.lit(0.7), 1 - share / 2)))))).otherwise(F.col("hits"))
    base = base.withColumn("hits", hits).withColumn("fell_back", none | thin)
    codes = F.transform("hits", lambda r: r["code"])
    clash = [F.when(F.array_contains(codes, a) & F.array_contains(codes, b), F.lit(k)) for k, (a, b) in contradictions.items()]
    clash.append(F.when(F.exists("hits", lambda r: F.coalesce(r["status"] == "conflicting_evidence", F.lit(False))), F.lit("rule_evidence_marked_conflicting")))
    base = base.withColumn("contradictions", F.array_compact(F.array(*clash)))
    first = F.col("hits")[0]
    sure = first["confidence"] - F.when(F.size("contradictions") > 0, 0.15).otherwise(0.0) - F.when(status == "conflicting_evidence", 0.1).otherwise(0.0)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))
    blocked = (F.size("contradictions") > 0) | F.coalesce("protected", F.lit(False)) | (first["grade"] == "X")
    review = F.col("fell_back") | (sure < 0.7) | (share < 0.3)
    plan = F.when(blocked, "blocked_or_human_review_required").when(review, "ready_ai_suggestion_review_required").otherwise("ready_ai_suggestion")
    return base.select(*rows.columns, first["code"].alias("decisive_code"), first["grade"].alias("decisive_grade"), sure.alias("confidence"), "contradictions", plan.alias("plan_status"))

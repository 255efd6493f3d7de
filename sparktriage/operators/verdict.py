"""Verdicts: the false-positive checklist, hard gates, votes, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALARM = ["pver_id", "group_id"]


def listed(column: str) -> Column:
    """A comma-separated list as an array; null and empty give an empty one."""
    return F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda x: x != "")


def witnessed() -> Column:
    """A true positive is claimed and its witness stands."""
    return (F.col("tp_claim") == "tp") & (F.col("tp_witness") == "found")


def fp_reasons() -> Column:
    """What keeps a false-positive claim from being ironclad, one text per failed check, in fixed order.

    Columns: both provers' claims, the false-positive prover's report, its classes as lists, and of the merged pack coverage,
    coverage_cap and has_bound (a fact that bounds the index or size). A class list that is a strict subset of all classes fails.
    """
    given, every = F.array_distinct(listed("addressed")), listed("classes")
    less = (F.size(F.array_except(given, every)) == 0) & (F.size(F.array_except(every, given)) > 0)
    checks = [
        (witnessed(), "tp witness found"),
        (F.col("fp_claim") != "fp", "no fp claim"),
        (F.col("coverage") != "full", "coverage not full"),
        (F.col("unaddressed") != "", "classes unaddressed"),
        (F.col("fp_error") != "", "prover error"),
        (F.col("index_range") == "unknown", "index range unknown"),
        (F.col("array_size") != "known", "array size unknown"),
        (F.col("fp_witness") == "found", "fp witness found"),
        (F.col("n_findings") == 0, "no findings"),
        (F.col("n_missing") > 0, "evidence missing"),
        (F.col("merged_coverage") == "partial", "merged coverage partial"),
        (F.col("coverage_cap") == "partial", "coverage capped"),
        ((F.size(every) > 0) & less, "classes not addressed"),
        (~F.col("has_bound") & (F.col("index_range") != "constant"), "no bound"),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]), lambda x: x.isNotNull())


def coerce_report(reports: DataFrame) -> DataFrame:
    """Values outside the allowed ones become the default, so a prover's claim of the other kind is none; a report without text, findings, missing evidence and classes is empty."""
    pick = lambda c, allowed, default: F.when(F.lower(c).isin(allowed), F.lower(c)).otherwise(default)
    return reports.withColumns({
        "fp_claim": pick("fp_claim", ["fp"], "no_credible_case"),
        "tp_claim": pick("tp_claim", ["tp"], "no_credible_case"),
        "index_range": pick("index_range", ["constant", "guard_bounded", "unknown"], "unknown"),
        "array_size": pick("array_size", ["known", "unknown"], "unknown"),
        "fp_witness": pick("fp_witness", ["found", "none"], "none"),
        "tp_witness": pick("tp_witness", ["found", "none"], "none"),
        "coverage": pick("coverage", ["full", "partial"], "partial"),
        "empty_report": (F.trim("rationale") == "") & (F.col("n_findings") == 0) & (F.col("n_missing") == 0) & (F.col("addressed") == ""),
    })


def gate(ironclad: Column) -> Column:
    """Both provers failed is uncertain, a witnessed claim is TP, an ironclad false positive FP; otherwise none, and the votes decide."""
    return (
        F.when((F.col("tp_error") != "") & (F.col("fp_error") != ""), "uncertain")
        .when(witnessed(), "TP").when((F.col("fp_claim") == "fp") & ironclad, "FP").otherwise("none")
    )


def hard_gate(reports: DataFrame) -> DataFrame:
    """The gate of each alarm and why its false positive is not ironclad."""
    return reports.select(*ALARM, gate(F.size(fp_reasons()) == 0).alias("gate"), F.array_join(fp_reasons(), ";").alias("reasons"))


def clamp(label: Column, ironclad: Column, tp_claimed: Column, witness: Column) -> Column:
    """P25: a witnessed claim makes every vote TP; FP that is not ironclad becomes TP if TP was claimed, else uncertain."""
    return F.when(witness, "TP").when((label == "FP") & ~ironclad, F.when(tp_claimed, "TP").otherwise("uncertain")).otherwise(label)


def _clamped(votes: DataFrame, reports: DataFrame) -> DataFrame:
    """Votes with what is known of their alarm; without a report nothing is claimed."""
    known = reports.select(
        *ALARM, (F.size(fp_reasons()) == 0).alias("ironclad"), (F.col("tp_claim") == "tp").alias("tp_claimed"), witnessed().alias("witness"),
        (F.col("tp_witness") == "found").alias("shown"), gate(F.size(fp_reasons()) == 0).alias("gate"),
    )
    both = votes.join(known, ALARM, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("ironclad", "tp_claimed", "witness", "shown")})
    return both.withColumns({"gate": F.coalesce("gate", F.lit("none")), "clamped": clamp(F.col("label"), F.col("ironclad"), F.col("tp_claimed"), F.col("witness"))})


def clamp_vote(votes: DataFrame, reports: DataFrame) -> DataFrame:
    """P25: votes with their clamped label."""
    return _clamped(votes, reports)


def final_verdict(votes: DataFrame, reports: DataFrame) -> DataFrame:
    """A gate decides alone. Else clamped votes are counted: half of them FP and ironclad is FP; FP as first of the most common but not
    ironclad is uncertain; a tie at the top is TP if a vote says so and a witness or a claim stands, else uncertain; and the winner is clamped.

    A new exploration is wanted where the verdict is uncertain and an uncertain vote asked for it. Of equally common labels the one of the earliest run is first.
    """
    kinds = ["TP", "FP", "uncertain"]
    known = _clamped(votes, reports)
    counts = [F.count_if(F.col("clamped") == v).alias(v.lower()) for v in kinds] + [F.min(F.when(F.col("clamped") == v, F.col("run"))).alias(f"{v.lower()}_at") for v in kinds]
    flags = [F.first(c).alias(c) for c in ("ironclad", "tp_claimed", "witness", "shown", "gate")]
    both = known.groupBy(*ALARM).agg(F.count("*").alias("n"), *counts, *flags, F.bool_or(F.col("reexplore") & (F.col("clamped") == "uncertain")).alias("asked"))
    first = F.array_max(F.array(*[F.struct(F.col(v.lower()).alias("n"), (-F.col(f"{v.lower()}_at")).alias("at"), F.lit(v).alias("label")) for v in kinds]))
    top = first["n"]
    tied = (F.col("tp") == top).cast("int") + (F.col("fp") == top).cast("int") + (F.col("uncertain") == top).cast("int") > 1
    won = (
        F.when((F.col("fp") > 0) & F.col("ironclad") & (2 * F.col("fp") >= F.col("n")), "FP")
        .when((F.col("fp") > 0) & ~F.col("ironclad"), F.when(first["label"] == "FP", "uncertain").otherwise(first["label"]))
        .when(tied, F.when((F.col("tp") > 0) & (F.col("shown") | F.col("tp_claimed")), "TP").otherwise("uncertain"))
        .otherwise(first["label"])
    )
    label = F.when(F.col("gate") != "none", F.col("gate")).otherwise(clamp(won, F.col("ironclad"), F.col("tp_claimed"), F.col("witness")))
    return both.withColumn("label", label).select(*ALARM, "n", "tp", "fp", "uncertain", "label", (F.col("asked") & (F.col("label") == "uncertain") & (F.col("gate") == "none")).alias("reexplore"))


def class_coverage(reports: DataFrame) -> DataFrame:
    """The false-positive prover's classes, coverage and what it left out, from its lists, kept findings, index_origin and the merged coverage.

    Classes that the alarm does not have are dropped. Where the index is made in the alarm function, callers can't alter it:
    one addressed class with a kept finding addresses all. Anything unaddressed, or a partial pack, makes the coverage partial.
    """
    given, every = F.array_intersect(listed("addressed"), listed("classes")), F.array_distinct(listed("classes"))
    closes = (F.col("index_origin") == "local") & (F.size(given) > 0) & (F.col("n_findings") > 0)
    told = reports.withColumns({"given": F.when(closes, every).otherwise(given), "left_out": F.when(closes, F.array().cast("array<string>")).otherwise(F.array_except(every, given))})
    coverage = F.when((F.size("left_out") > 0) | (F.col("merged_coverage") == "partial"), "partial").otherwise(F.col("coverage"))
    return told.withColumns({"coverage": coverage, "addressed": F.array_join("given", ","), "unaddressed": F.array_join("left_out", ",")}).drop("given", "left_out")


def validate_reports(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Reports after their findings (…, agent, supported) were checked; n_findings is what the false-positive prover keeps.

    A witness without a kept finding of its prover goes, and with it the true-positive claim; class coverage is worked out anew
    (U03); a false-positive claim that is then not ironclad (P23) is withdrawn. dropped lists what was taken away.
    """
    count = lambda agent, ok: F.count_if((F.col("agent") == agent) & (F.col("supported") == ok))
    counts = findings.groupBy(*ALARM).agg(count("FP_PROVE", True).alias("fp_kept"), count("FP_PROVE", False).alias("fp_lost"), count("TP_PROVE", True).alias("tp_kept"), count("TP_PROVE", False).alias("tp_lost"))
    names = ["fp_kept", "fp_lost", "tp_kept", "tp_lost"]
    both = reports.join(counts, ALARM, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in names})
    cleared = witnessed() & (F.col("tp_kept") == 0)
    both = both.withColumn("cleared", cleared).withColumns({"tp_witness": F.when(F.col("cleared"), "none").otherwise(F.col("tp_witness")), "n_findings": F.col("fp_kept")})
    both = both.withColumn("down", (F.col("tp_claim") == "tp") & (F.col("tp_witness") != "found")).withColumn("tp_claim", F.when(F.col("down"), "no_credible_case").otherwise(F.col("tp_claim")))
    checked = class_coverage(both).withColumn("reasons", fp_reasons())
    soft = (F.col("fp_claim") == "fp") & (F.size("reasons") > 0)
    lost = [
        (F.col("tp_error") != "", "tp prover failed"), (F.col("fp_error") != "", "fp prover failed"), (F.col("tp_lost") > 0, "tp findings"), (F.col("fp_lost") > 0, "fp findings"),
        (F.col("cleared"), "tp witness"), (F.col("down"), "tp claim"), (soft, "fp claim"),
    ]
    return checked.select(
        *ALARM, "tp_claim", F.when(soft, "no_credible_case").otherwise(F.col("fp_claim")).alias("fp_claim"), "tp_witness", "coverage", "addressed", "unaddressed", *names,
        F.concat_ws(";", *[F.when(bad, F.lit(text)) for bad, text in lost]).alias("dropped"),
    )


def score(labelled: DataFrame) -> DataFrame:
    """Per reviewer kind, the confusion of predictions with labels, wrong verdicts and recalls; rows without a label are left out."""
    human = F.when(F.lower("human_label").isin("true", "tp"), "TP").when(F.lower("human_label").isin("false", "fp"), "FP")
    kind = F.when(F.col("comment").contains("TOOL"), "tool").otherwise("person")
    rows = labelled.select(human.alias("h"), "prediction", kind.alias("reviewer")).where("h is not null")
    cell = lambda h, p: F.count_if((F.col("h") == h) & (F.col("prediction") == p))
    recall = lambda v: F.round(cell(v, v) / F.greatest(F.count_if(F.col("h") == v), F.lit(1)), 6)
    return rows.groupBy("reviewer").agg(
        F.count("*").alias("n"), cell("TP", "TP").alias("tp_tp"), cell("FP", "FP").alias("fp_fp"), cell("TP", "FP").alias("wrong_fp"), cell("FP", "TP").alias("wrong_tp"),
        F.count_if(F.col("prediction") == "uncertain").alias("uncertain"), recall("TP").alias("recall_tp"), recall("FP").alias("recall_fp"))


def run_report(runs: DataFrame) -> DataFrame:
    """Per project its orders, how many are done or failed, predictions by label, calls, tokens in and out, and the time from the first start to the last end, in microseconds."""
    label = lambda v: F.count_if(F.col("label") == v)
    return runs.groupBy("pver_id").agg(
        F.count("*").alias("orders"), F.count_if(F.col("status") == "done").alias("completed"), F.count_if(F.col("status") == "error").alias("errors"),
        label("TP").alias("tp"), label("FP").alias("fp"), label("uncertain").alias("uncertain"), F.sum("calls").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        (F.unix_micros(F.max("ended").cast("timestamp")) - F.unix_micros(F.min("started").cast("timestamp"))).alias("wall_micros"))

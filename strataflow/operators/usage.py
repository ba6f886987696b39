"""Usage metrics and spending windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.ranks import value_ranks

OUTCOMES = ("click", "error", "purchase", "signup", "view")


def availability(total: Column, exact: Column, estimated: Column, rows: Column, methods: Column) -> Column:
    """``exact`` if all records are, ``estimate`` if all are estimated by one method, else ``unavailable``."""
    return F.when(exact == rows, "exact").when((estimated == rows) & (methods == 1), "estimate").otherwise("unavailable")


def by_day(metrics: DataFrame, first: str, last: str, keys: tuple[str, ...] = ("model", "actual_model", "fallback_model", "effort")) -> DataFrame:
    """Conditional sums per day and the planner's keys, over a range of days."""
    some = metrics.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    sums = [F.sum(F.when(F.col("outcome") == o, 1).otherwise(0)).alias(f"n_{o}") for o in OUTCOMES]
    return some.groupBy("day", *keys).agg(*sums, F.sum("duration").alias("duration"), F.sum("tokens").alias("tokens"), F.count("tokens").alias("n_tokens"), F.max("budget").alias("max_budget"))


def by_model(metrics: DataFrame) -> DataFrame:
    """Conditional sums per day and model, the actual model standing in where it is named."""
    model = F.coalesce(F.when(F.col("actual_model") != "", F.col("actual_model")), F.col("model"))
    sums = [F.sum(F.when(F.col("outcome") == o, 1).otherwise(0)).alias(f"n_{o}") for o in OUTCOMES]
    return metrics.groupBy("day", model.alias("model")).agg(
        *sums, F.sum("duration").alias("duration"), F.sum("tokens").alias("tokens"), F.count("tokens").alias("n_tokens"), F.max("budget").alias("max_budget"),
        F.countDistinct(F.when(F.col("tokens").isNotNull(), F.col("outcome"))).alias("n_outcomes"), F.min(F.when(F.col("availability") == "exact", F.col("tokens"))).alias("least_exact"),
    )


def lattice(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Token totals with their availability; ``estimate_method`` tells how a record was estimated."""
    is_ = lambda x: F.sum(F.when(F.col("availability") == x, 1).otherwise(0))
    grouped = metrics.groupBy(*keys).agg(F.sum("tokens").alias("total"), F.count("*").alias("rows"), is_("exact").alias("exact"), is_("estimate").alias("estimated"), F.countDistinct(F.when(F.col("availability") == "estimate", F.coalesce("estimate_method", F.lit("")))).alias("methods"))
    state = availability(F.col("total"), F.col("exact"), F.col("estimated"), F.col("rows"), F.col("methods"))
    return grouped.select(*keys, F.when(state != "unavailable", F.col("total")).alias("total"), state.alias("availability"))


def monthly(groups: DataFrame) -> DataFrame:
    """Second-level totals: exact only if every group is."""
    month = F.date_format("day", "yyyy-MM").alias("month")
    all_exact = F.min((F.col("availability") == "exact").cast("int"))
    return groups.groupBy(month).agg(F.when(all_exact == 1, F.sum("total")).alias("total"), F.when(all_exact == 1, "exact").otherwise("unavailable").alias("availability"))


def windows(spend: DataFrame, now: Column) -> DataFrame:
    """Spend since the start of the UTC day, the Monday week and the month that hold ``now``, as one row."""
    since = lambda unit: F.coalesce(F.sum(F.when((F.col("recorded_at") >= F.date_trunc(unit, now)) & (F.col("recorded_at") <= now), F.col("amount"))), F.lit(0))
    return spend.agg(since("DAY").alias("day_used"), since("WEEK").alias("week_used"), since("MONTH").alias("month_used"))


def grant(used: dict[str, float], limits: dict[str, float | None], most: float, least: float) -> float | None:
    """What may be reserved: the asked maximum (0 asks for all there is) within every enabled limit; None if
    that is too little. Without any limit the maximum is granted and nothing needs recording."""
    enabled = [limits[w] - used[w] for w in limits if limits[w]]
    if not enabled:
        return most
    amount = min([most or float("inf"), *enabled])
    return amount if amount >= least and amount > 0 else None


def settle(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """Reservations with their exact amounts where one was reported and is not above the reservation."""
    fixed = corrections.select("reservation_id", F.col("amount").alias("exact"))
    return ledger.join(fixed, "reservation_id", "left").withColumn("amount", F.when(F.col("exact") <= F.col("amount"), F.col("exact")).otherwise(F.col("amount"))).drop("exact")


def at_rank(rows: DataFrame, keys: list[str], value: str, position, name: str) -> DataFrame:
    """Per key, the value at ``position`` (0-based, a function of the number of the key's rows) of its sorted values.

    Exact selection by ranges: values merge with their counts, are dealt over ranges of (key, value) and get their
    ranks from prefix sums, so the rows of one key are spread over tasks.
    """
    ranked = value_ranks(rows, keys, F.col(value), "_before")
    at = position(F.col("_total"))
    return ranked.filter((F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))).select(*keys, F.col("_value").alias(name))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at position n // 2 of the sorted values, by rank and not by approximation."""
    return at_rank(rows, keys, value, lambda n: F.floor(n / 2), "median")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The element at position ceil(p*n)-1 of the sorted values."""
    return at_rank(rows, keys, value, lambda n: F.ceil(F.lit(p) * n) - 1, "percentile")


def question_baseline(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Recall at 10, intent accuracy, seed diversity over ranked answers (question, rank, path, node_id, intent)."""
    hit = answers.filter("rank <= 10").join(truth.select("question", F.col("node_id").alias("wanted")), "question").groupBy("question").agg(F.max((F.col("node_id") == F.col("wanted")).cast("int")).alias("hit"))
    shape = answers.groupBy("question").agg((F.countDistinct("path") / F.count("*")).alias("diversity"), F.max("intent").alias("intent"))
    joined = truth.select("question", F.col("intent").alias("expected")).distinct().join(hit, "question", "left").join(shape, "question", "left")
    return joined.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall_at_10"), F.avg(F.coalesce((F.col("intent") == F.col("expected")).cast("int"), F.lit(0))).alias("intent_accuracy"), F.avg("diversity").alias("seed_diversity"))


def benchmark_errors(runs: list[dict], limits: dict[str, float], runs_wanted: int = 3, noise: float = 0.01) -> list[str]:
    """What is wrong with a benchmark's runs: their number, order, checksums, medians, and peak memory.

    A run is a dict with ``index``, ``checksum``, ``peak_bytes`` and one number per metric of ``limits``; the
    limit of ``peak_bytes`` holds for the median, and with ``noise`` on top for each run.
    """
    out = [] if len(runs) == runs_wanted else [f"{len(runs)} runs instead of {runs_wanted}"]
    out += ["runs are out of order"] if [r.get("index") for r in runs] != list(range(len(runs))) else []
    out += ["checksums differ between runs"] if len({r.get("checksum") for r in runs}) > 1 else []
    for metric, most in limits.items():
        values = [r.get(metric) for r in runs]
        if not runs or any(v is None or v < 0 for v in values):
            out.append(f"{metric} is missing or negative")
            continue
        median = sorted(values)[len(values) // 2]
        out += [f"{metric}: median {median} is over {most}"] if median > most else []
        out += [f"{metric}: a run is over {most} by more than noise"] if metric == "peak_bytes" and max(values) > most * (1 + noise) else []
    return out


def growth_errors(small: dict, large: dict) -> list[str]:
    """Retained memory must grow by less than half as fast as the corpus (both have ``size``, ``retained_bytes``)."""
    corpus, heap = large["size"] / small["size"], large["retained_bytes"] / small["retained_bytes"]
    return [] if corpus > 1 and heap < corpus / 2 else [f"retained memory grew {heap:.2f} times over a corpus {corpus:.2f} times as large"]

"""Steps of chained imputation: profile, methods, first fill, draws per target."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.scalars import hash_long, hash_uniform
from trialweave.operators.logistic import EVERY_GROUP
from trialweave.operators.ordering import ROWS_PER_BUCKET, numbered, sorted_neighbours
from trialweave.operators.prep import quoted

# Donors considered per missing value, ridge of the linear draw.
DONORS = 5
RIDGE = 1e-5


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_name, n_missing`` for the columns that have missing values."""
    columns = columns or df.columns
    counts = df.agg(*[F.sum(quoted(c).isNull().cast("long")).alias(c) for c in columns])
    return counts.unpivot([], [quoted(c) for c in columns], "column_name", "n_missing").filter(F.col("n_missing") > 0)


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``name, level, n`` of every category; missing cells count under a NULL level."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), quoted(c).cast("string").alias("level")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("name", "level").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Variable:
    """A modelled column: its method (``pmm``, ``logreg``, ``polyreg`` or none) and encoding."""

    name: str
    numeric: bool
    n_missing: int
    n_observed: int
    levels: tuple[str, ...] = ()
    counts: tuple[int, ...] = ()
    mean: float = 0.0
    sd: float = 1.0
    low: float = 0.0
    high: float = 0.0

    @property
    def method(self) -> str:
        if self.n_missing == 0 or self.n_observed == 0:
            return ""
        if self.numeric:
            return "pmm"
        return {0: "", 1: "", 2: "logreg"}.get(len(self.levels), "polyreg")

    @property
    def usable(self) -> bool:
        """Whether the column can be a predictor: varying, and complete once imputed."""
        varies = self.sd > 0 if self.numeric else len(self.levels) > 1
        return varies and (self.n_missing == 0 or self.method != "")

    def terms(self) -> list[str]:
        """SQL of this column's part of a design row."""
        c = f"`{self.name}`"
        if self.numeric:
            return [f"({c} - {self.mean!r}D) / {self.sd!r}D"]
        return [f"if({c} = {k}, 1D, 0D)" for k in range(1, len(self.levels))]

    def decoded(self, dtype, value: Column | None = None) -> Column:
        """The column again, from its code or number (by default in the column of its name)."""
        value = quoted(self.name) if value is None else value
        if self.numeric:
            return value.cast(dtype).alias(self.name)
        texts = F.array(*[F.lit(v) for v in self.levels]).cast("array<string>")
        return F.get(texts, value.cast("int")).cast(dtype).alias(self.name)


def as_known(name: str) -> Column:
    """A number, or NULL where it is missing, no number or NaN."""
    x = quoted(name).try_cast("double")
    return F.when(~F.isnan(x), x)


def encoded(df: DataFrame, variables_: list[Variable], others: list[str | Column]) -> DataFrame:
    """``others``, numbers as double, and categories as position in the sorted level list."""
    # A loop over arrays: a search for each column would be more code than the JVM compiles.
    coded = [v for v in variables_ if not v.numeric]
    texts = F.array(*[quoted(v.name).cast("string") for v in coded]).cast("array<string>")
    levels = F.array(*[F.array(*[F.lit(x) for x in v.levels]).cast("array<string>") for v in coded]).cast("array<array<string>>")
    place = lambda x, known: F.when(F.array_position(known, x) > 0, (F.array_position(known, x) - 1).cast("int"))
    df = df.withColumn("__codes", F.zip_with(texts, levels, place))
    at = {v.name: F.get("__codes", F.lit(i)).alias(v.name) for i, v in enumerate(coded)}
    return df.select(*others, *[at.get(v.name, as_known(v.name).alias(v.name)) for v in variables_])


def variables(df: DataFrame, numeric: list[str], categories: list[str]) -> list[Variable]:
    """Inspect all modelled columns in two jobs."""
    n = {}
    for r in level_counts(df, categories).collect():
        n.setdefault(r["name"], {})[r["level"]] = r["n"]
    stats = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[
            f(as_known(c)).alias(f"{c}__{tag}")
            for c in numeric
            for tag, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop), ("low", F.min), ("high", F.max))
        ],
    ).first()
    out = []
    for c in categories:
        seen = n.get(c, {})
        lev = sorted(v for v in seen if v is not None)
        cnt = tuple(seen[v] for v in lev)
        out.append(Variable(c, False, seen.get(None, 0), sum(cnt), tuple(lev), cnt))
    for c in numeric:
        k = stats[f"{c}__n"]
        seen = {tag: stats[f"{c}__{tag}"] or 0.0 for tag in ("mean", "sd", "low", "high")}
        out.append(Variable(c, True, stats["__rows"] - k, k, **seen))
    return out


def mask(name: str) -> str:
    return f"__missing_{name}"


def design(variables_: list[Variable], target: Variable) -> tuple[Column, int]:
    """Design array of all usable columns but the target, and its length."""
    terms = [t for v in variables_ if v.usable and v.name != target.name for t in v.terms()]
    return F.expr(f"array({', '.join(terms)})"), len(terms)


def first_fill(
    open_rows: DataFrame, all_rows: DataFrame, targets: list[Variable], keys: list[str], seed: int, m: int, apart: bool = True
) -> DataFrame:
    """``m`` copies of the rows, told apart by ``imputation``, each missing cell filled with a random observed value of its column.

    Categories are drawn from level shares. A missing number picks a random position among
    the observed values, which are numbered in parallel; all numeric columns share one join. Rows are copied
    last, so that they move once for all copies; without ``apart`` they are not, and arrays ``__fill_<name>`` hold
    what each copy would be filled with. What is joined grows with the rows, which the size of their files
    says little of: never broadcast.
    """
    numbers = [t for t in targets if t.numeric]
    df, chains = open_rows, F.sequence(F.lit(1), F.lit(m))
    spark = df.sparkSession
    # A number of partitions that stays: by their size, small rows would be packed into few tasks, here and in all later steps.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if numbers:
        cells = F.array(*[F.struct(F.lit(v.name).alias("target"), F.col(v.name).alias("value")) for v in numbers])
        observed = all_rows.select(*keys, F.inline(cells)).filter(F.col("value").isNotNull())
        count = sum(v.n_observed for v in numbers)
        observed = numbered(observed, ["target"], hash_long(seed, F.col("target"), *[F.col(k) for k in keys]), "nth", rows=count)
        holes = F.array(
            *[
                F.when(
                    F.col(mask(v.name)),
                    F.struct(F.lit(v.name).alias("target"), F.lit(v.n_observed).cast("long").alias("total")),
                )
                for v in numbers
            ]
        )
        drawn = (
            df.select(*keys, F.explode(F.filter(holes, lambda h: h.isNotNull())).alias("h"))
            .select(*keys, "h.*", F.explode(chains).alias("imputation"))
            .withColumn(
                "nth",
                F.pmod(hash_long(seed + 1, F.col("imputation"), F.col("target"), *[F.col(k) for k in keys]), F.col("total")) + 1,
            )
            .join(observed.select("target", "nth", "value").hint("merge"), ["target", "nth"])
            .select(*keys, "target", "imputation", "value")
            .repartition(parts, *keys)  # as they are: a cell is smaller than a row of sums
            .groupBy(*keys)
            .agg(
                *[
                    F.array(*[F.max(F.when((F.col("target") == v.name) & (F.col("imputation") == i), F.col("value"))) for i in range(1, m + 1)]).alias(f"__fill_{v.name}")
                    for v in numbers
                ]
            )
        )
        df = df.join(drawn.hint("merge"), keys, "left")
    def code(i: int, v: Variable, chain: Column) -> Column:
        u = hash_uniform(seed + 1000 + i, chain, *[F.col(k) for k in keys])
        shares = np.cumsum(v.counts) / sum(v.counts)
        out = F.lit(len(shares) - 1)
        for k in reversed(range(len(shares) - 1)):
            out = F.when(u < float(shares[k]), k).otherwise(out)
        return out

    categories = [t for t in targets if not t.numeric]
    if not apart:
        none = F.array_repeat(F.lit(None).cast("double"), m)
        fills = {f"__fill_{v.name}": F.coalesce(f"__fill_{v.name}", none) for v in numbers}
        fills |= {f"__fill_{v.name}": F.array(*[code(i, v, F.lit(g)) for g in range(1, m + 1)]) for i, v in enumerate(categories)}
        return df.withColumns(fills)
    df = df.withColumn("imputation", F.explode(chains))
    filled = {v.name: F.coalesce(v.name, F.get(f"__fill_{v.name}", F.col("imputation") - 1)) for v in numbers}
    df = df.withColumns(filled).drop(*[f"__fill_{v.name}" for v in numbers])
    for i, v in enumerate(categories):
        df = df.withColumn(v.name, F.when(F.col(mask(v.name)), code(i, v, F.col("imputation"))).otherwise(F.col(v.name)))
    return df


def linear_sums(rows: DataFrame, p: int) -> dict[int, np.ndarray]:
    """Cross-products of ``(x, 1, y)`` per group, from one pass over ``group, x, y``."""

    def partials(batches):
        total: dict = {}
        for batch in batches:
            group = batch.column("group").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            z = np.column_stack([x, np.ones(len(x)), batch.column("y").to_numpy()])
            for g in np.unique(group):
                part = z[group == g]
                total[int(g)] = total.get(int(g), 0) + (part.T @ part).ravel()
        if total:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(total), pa.int32()),
                    pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64())),
                ],
                names=["group", "sums"],
            )

    parts = rows.mapInArrow(partials, "group int, sums array<double>")
    out = parts.groupBy("group").agg(Summarizer.sum(array_to_vector(F.col("sums"))).alias("sums")).collect()
    return {r.group: r.sums.toArray().reshape(p + 2, p + 2) for r in out}


def linear_draw(z: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares coefficients and one draw around them, from cross-products."""
    xtx, xty, yty, n = z[:-1, :-1], z[:-1, -1], z[-1, -1], z[-2, -2]
    v = np.linalg.pinv(xtx + RIDGE * np.diag(np.diag(xtx)), hermitian=True)
    c = v @ xty
    rss = max(yty - 2 * c @ xty + c @ xtx @ c, 0.0)
    df = max(n - len(c), 1)
    sigma = np.sqrt(rss / rng.chisquare(df))
    w, q = np.linalg.eigh((v + v.T) / 2)
    return c, c + sigma * (q * np.sqrt(np.clip(w, 0, None))) @ rng.standard_normal(len(c))


def donor_draw(
    donors: DataFrame,
    asking: DataFrame,
    groups: list[str],
    keys: list[str],
    seed: int,
    k: int = DONORS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    rows: int | None = None,
) -> DataFrame:
    """Give each asking row the value of one of its ``k`` nearest donors.

    ``donors``: groups, keys, ``score``, ``y``; ``asking``: groups, ``score``, ``me`` (struct holding the
    keys). Returns groups, ``me``, ``y``.
    """
    mine = [F.col(f"me.{c}") for c in keys]
    none = F.lit(False)
    d = donors.select(
        *groups,
        "score",
        F.struct("y").alias("donor"),
        hash_uniform(seed, *[F.col(c) for c in keys]).alias("__u"),
        F.lit(None).cast(asking.schema["me"].dataType).alias("me"),
    )
    a = asking.select(
        *groups,
        "score",
        F.when(none, F.struct(F.lit(None).cast(donors.schema["y"].dataType).alias("y"))).alias("donor"),
        hash_uniform(seed + 1, *mine).alias("__u"),
        "me",
    )
    found = sorted_neighbours(d.unionByName(a), groups, "score", "donor", "__u", k, rows_per_bucket, rows)
    # At most 2k candidates; the k nearest of them are the k nearest of all donors.
    near = F.slice(
        F.array_sort(
            F.transform(
                F.concat("below", "above"),
                lambda x: F.struct(
                    F.abs(x["score"] - F.col("score")).alias("d"), x["score"].alias("s"), x["donor"]["y"].alias("y")
                ),
            )
        ),
        1,
        k,
    )
    nth = F.floor(hash_uniform(seed + 2, *[F.col(c) for c in groups], *mine) * F.size("__near")).cast("int")
    return (
        found.withColumn("__near", near)
        .withColumn("y", F.get("__near", nth)["y"])
        .select(*groups, "me", "y")
    )


def every_group(df: DataFrame) -> DataFrame:
    """Mark rows that are the same in all chains."""
    return df.withColumn("imputation", F.lit(EVERY_GROUP))

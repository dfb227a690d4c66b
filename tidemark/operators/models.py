"""Models per fold from sufficient statistics: sums of products in one aggregation, solved where they lie.

A linear model needs of its rows only their sums of products, which partial aggregation makes in every task; what
is shuffled and solved is one row for each group (a fold, or a fold and a horizon), and no row of the table
reaches the driver. The system is solved by Cholesky's method in array functions. A logistic model repeats that with
the weights of the round before, until no coefficient moves; a round is one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, few

_NONE = "cast(array() as array<double>)"


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (u, v) -> u * v), 0D, (s, u) -> s + u)"


def solve(matrix: str, right: str) -> Column:
    """x of matrix x = right, for columns of a symmetric positive definite array of rows and an array; NULL where it is not positive definite."""
    n = f"size({right})"
    # Each row of the lower triangle from the rows before it; a pivot that is not positive makes NULL, and so all after it.
    value = f"transform(array({matrix}[i][j] - {_dot('row', 'slice(if(j < i, rows[if(j < i, j, 0)], row), 1, size(row))')}), s -> if(i = j, if(s > 1e-12D * {matrix}[i][i], sqrt(s), null), s / rows[if(j < i, j, 0)][j]))[0]"
    lower = f"aggregate(sequence(0, {n} - 1), cast(array(array()) as array<array<double>>), (rows, i) -> if(i = 0, array(aggregate(sequence(0, 0), {_NONE}, (row, j) -> concat(row, array(if({matrix}[0][0] > 0, sqrt({matrix}[0][0]), null))))), concat(rows, array(aggregate(sequence(0, i), {_NONE}, (row, j) -> concat(row, array({value})))))))"
    ahead = f"aggregate(sequence(0, {n} - 1), {_NONE}, (z, i) -> concat(z, array(({right}[i] - {_dot('z', 'slice(l[i], 1, size(z))')}) / l[i][i])))"
    back = f"aggregate(sequence({n} - 1, 0, -1), {_NONE}, (w, i) -> concat(array((z[i] - {_dot('w', 'transform(slice(l, i + 2, size(w)), r -> r[i])')}) / l[i][i]), w))"
    whole = f"transform(array({lower}), l -> transform(array({ahead}), z -> {back})[0])[0]"
    return F.expr(f"if({n} = 0, {_NONE}, transform(array({whole}), x -> if(exists(x, e -> e is null or isnan(e)), null, x))[0])")


def _moments(x: Sequence[Column], weight: Column) -> list[Column]:
    return [F.sum(weight * a * b).alias(f"__{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j <= i]


def _symmetric(n: int) -> Column:
    return F.array(*[F.array(*[F.col(f"__{max(i, j)}_{min(i, j)}") for j in range(n)]) for i in range(n)])


def ridge(rows: DataFrame, groups: Sequence[str], features: Sequence[str], target: str, penalty: float = 1.0) -> DataFrame:
    """(groups, n, coefficients, intercept): least squares with ``penalty`` on the squares of the coefficients, not of the intercept.

    Rows with a null among features or target take no part. Features are centred by their means, so that the intercept
    is exact. Coefficients are NULL where the system cannot be solved: without a penalty, where features depend on each other.
    """
    x = [F.col(c).cast("double") for c in features]
    y, k = F.col(target).cast("double"), len(features)
    whole = rows.dropna(subset=[*features, target])
    # Shifted by the means first: sums of products about zero keep their digits.
    means = cut(whole.groupBy(*groups).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"__m{i}") for i, c in enumerate([*x, y])]))
    moved = whole.join(few(means), list(groups)) if groups else whole.crossJoin(means)
    parts = [c - F.col(f"__m{i}") for i, c in enumerate([*x, y])]
    sums = moved.groupBy(*groups, "n", *[f"__m{i}" for i in range(k + 1)]).agg(*_moments(parts, F.lit(1.0)))
    lam = lambda i, j: F.lit(float(penalty)) if i == j else F.lit(0.0)
    matrix = F.array(*[F.array(*[F.col(f"__{max(i, j)}_{min(i, j)}") + lam(i, j) for j in range(k)]) for i in range(k)])
    solved = sums.withColumns({"__a": matrix, "__b": F.array(*[F.col(f"__{k}_{i}") for i in range(k)])}).withColumn("coefficients", solve("__a", "__b"))
    level = F.col(f"__m{k}") - sum((F.get("coefficients", F.lit(i)) * F.col(f"__m{i}") for i in range(k)), F.lit(0.0))
    return solved.select(*groups, "n", "coefficients", level.alias("intercept"))


def linear(features: Sequence[str]) -> Column:
    """The score of a row joined with (coefficients, intercept)."""
    return sum((F.get("coefficients", F.lit(i)) * F.col(c).cast("double") for i, c in enumerate(features)), F.col("intercept"))


def logistic(rows: DataFrame, groups: Sequence[str], features: Sequence[str], target: str, penalty: float = 1.0, rounds: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """(groups, n, coefficients, intercept, rounds): of the chance that target (0 or 1) is 1, by Newton's method with ``penalty`` on half the squares of the coefficients.

    Groups whose target never varies, or whose system cannot be solved, have NULL coefficients. A group that has come to
    rest stays as it is while others go on; after ``rounds`` the last values stand.
    """
    k = len(features)
    whole = cut(rows.dropna(subset=[*features, target]).select(*groups, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("__y")))
    share = F.avg("__y")
    now = whole.groupBy(*groups).agg(F.count("*").alias("n"), share.alias("__s"))
    start = F.when((F.col("__s") > 0) & (F.col("__s") < 1), F.concat(F.array_repeat(F.lit(0.0), k), F.array(F.ln(F.col("__s") / (1 - F.col("__s"))))))
    now = cut(now.select(*groups, "n", start.alias("beta"), F.lit(0).alias("rounds"), start.isNull().alias("rests")))
    x = [*[F.col(f"__x{i}") for i in range(k)], F.lit(1.0)]
    for _ in range(rounds):
        live = now.filter("not rests")
        if live.isEmpty():
            break
        both = whole.join(few(live.select(*groups, "beta")), list(groups)) if groups else whole.crossJoin(live.select("beta"))
        score = sum((F.col("beta")[i] * c for i, c in enumerate(x)), F.lit(0.0))
        both = both.withColumn("__p", 1 / (1 + F.exp(-F.greatest(F.least(score, F.lit(500.0)), F.lit(-500.0)))))
        w = F.col("__p") * (1 - F.col("__p"))
        sums = both.groupBy(*groups).agg(*_moments(x, w), *[F.sum(c * (F.col("__y") - F.col("__p"))).alias(f"__g{i}") for i, c in enumerate(x)])
        step = live.join(sums, list(groups)) if groups else live.crossJoin(sums)
        pen = [F.lit(float(penalty))] * k + [F.lit(0.0)]
        matrix = F.array(*[F.array(*[F.col(f"__{max(i, j)}_{min(i, j)}") + (pen[i] if i == j else F.lit(0.0)) for j in range(k + 1)]) for i in range(k + 1)])
        right = F.array(*[F.col(f"__g{i}") - pen[i] * F.col("beta")[i] for i in range(k + 1)])
        step = step.withColumns({"__a": matrix, "__b": right}).withColumn("__d", solve("__a", "__b"))
        moved = F.array_max(F.transform("__d", F.abs))
        step = step.select(*groups, "n", F.zip_with("beta", "__d", lambda a, b: a + b).alias("beta"), (F.col("rounds") + 1).alias("rounds"), F.coalesce(moved < tolerance, F.lit(True)).alias("rests"))
        step = step.withColumn("beta", F.when(~F.exists("beta", lambda e: e.isNull()), F.col("beta")))
        now = cut(now.filter("rests").unionByName(step))
    return now.select(*groups, "n", F.slice("beta", 1, k).alias("coefficients"), F.get("beta", F.lit(k)).alias("intercept"), "rounds")


def probability(features: Sequence[str]) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(linear(features), F.lit(500.0)), F.lit(-500.0))))


def walk_forward(assigned: DataFrame, groups: Sequence[str], features: Sequence[str], result: str, outcome: str, penalty: float = 1.0) -> DataFrame:
    """assigned's rows that are not TRAIN, with predicted (of result) and p (that outcome is 1), each by the models of its group's TRAIN rows alone.

    assigned: rows with role and groups (a fold), as the splits give them. Imputation, limits and scales are of TRAIN rows, too.
    """
    from .splits import standardise, train_only_fit

    ready = cut(standardise(assigned, train_only_fit(assigned, groups, features), groups, features))
    made = [f"{c}_x" for c in features]
    train = ready.filter("role = 'TRAIN'")
    line, chance = ridge(train, groups, made, result, penalty), logistic(train, groups, made, outcome, penalty)
    late = ready.filter("role <> 'TRAIN'")
    late = late.join(few(cut(line.drop("n"))), list(groups)).withColumn("predicted", linear(made)).drop("coefficients", "intercept")
    late = late.join(few(chance.drop("n", "rounds")), list(groups), "left").withColumn("p", probability(made)).drop("coefficients", "intercept")
    return late.drop(*made, *[f"{c}_imputed" for c in features])

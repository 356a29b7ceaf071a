"""Agreement between two stage columns (AGG7-AGG12, AGG17-AGG19, J9, FLT10).

The rows are reduced to a few counted cells per group in one pre-aggregated
pass. The cells of a group then become one row holding the whole 5 x 5 matrix,
and every metric is an expression over that row: no grid join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwright import schema as S
from epochwright.functions.arrays import share
from epochwright.functions.labels import stage_name

_CODES = S.N_STAGES + 1  # the stages, and one code for every other label or none


def _code(label: Column) -> Column:
    return F.when(label.between(0, S.N_STAGES - 1), label).otherwise(S.N_STAGES)


def _plus(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def agreement(df: DataFrame, true: str, pred: str, by: list[str] = []) -> DataFrame:
    """One row per ``by`` group with everything the reports need.

    ``n_epochs``, ``accuracy`` over all rows (AGG9); ``cm``: 5 x 5 counts, rows
    true, columns predicted, labels outside 0..4 ignored (AGG7 on the full grid,
    J9); ``scores``: per class precision, recall, F1, support (AGG8);
    ``macro_f1``: mean F1 over the classes seen on either side (AGG10);
    ``cohen_kappa`` from the matrix, NaN when chance agreement is total (AGG11).

    Labels are folded to six codes before counting, so a group never has more
    than 36 cells. Plain sums and arithmetic keep it all in generated code.
    """
    t, p = F.col(true), F.col(pred)
    codes, stages = range(_CODES), S.STAGES
    cells = df.groupBy(
        *by, (_code(t) * _CODES + _code(p)).cast("int").alias("_cell")
    ).agg(F.count(F.lit(1)).alias("_n"), F.count_if(t == p).alias("_hits"))
    counted = cells.groupBy(*by).agg(
        F.expr("coalesce(sum(_n), 0L)").alias("n_epochs"),
        F.expr("coalesce(sum(_hits), 0L)").alias("_hits"),
        *[
            F.expr(f"coalesce(sum(if(_cell = {i * _CODES + j}, _n, 0L)), 0L)").alias(f"c{i}{j}")
            for i in codes
            for j in codes
        ],
    )
    sums = counted.select(
        "*",
        *[F.expr(_plus(f"c{s}{j}" for j in codes)).alias(f"t{s}") for s in stages],
        *[F.expr(_plus(f"c{i}{s}" for i in codes)).alias(f"p{s}") for s in stages],
    )
    scored = sums.select(
        "*",
        *[
            F.expr(f"coalesce(try_divide(2D * c{s}{s}, t{s} + p{s}), 0D)").alias(f"f{s}")
            for s in stages
        ],
    )
    matrix = [[f"c{i}{j}" for j in stages] for i in stages]
    total = _plus(f"double({c})" for row in matrix for c in row)
    agreed = _plus(f"double(c{s}{s})" for s in stages)
    chance = _plus(
        f"double({_plus(matrix[s])}) * double({_plus(row[s] for row in matrix)})" for s in stages
    )
    gain, ceiling = f"{total} * {agreed} - {chance}", f"{total} * {total} - {chance}"
    scores = ", ".join(
        f"named_struct('precision', coalesce(try_divide(double(c{s}{s}), p{s}), 0D), "
        f"'recall', coalesce(try_divide(double(c{s}{s}), t{s}), 0D), 'f1', f{s}, 'support', t{s})"
        for s in stages
    )
    present = _plus(f"if(t{s} + p{s} > 0, 1, 0)" for s in stages)
    rows = ", ".join(f"array({', '.join(row)})" for row in matrix)
    return scored.select(
        *by,
        "n_epochs",
        share(F.col("_hits"), F.col("n_epochs")).alias("accuracy"),
        # an absent class has F1 0 and so adds nothing to the sum
        F.expr(f"coalesce(try_divide({_plus(f'f{s}' for s in stages)}, {present}), 0D)").alias(
            "macro_f1"
        ),
        F.expr(f"coalesce(try_divide({gain}, {ceiling}), double('NaN'))").alias("cohen_kappa"),
        F.expr(f"array({rows})").alias("cm"),
        F.expr(f"array({scores})").alias("scores"),
    )


def confusion(counted: DataFrame, by: list[str] = []) -> DataFrame:
    """AGG7 + J9 + AGG12 in long form: ``true``, ``pred``, ``n``, ``row_share``."""
    rows = counted.select(*by, F.posexplode("cm").alias("true", "_row"))
    total = F.aggregate("_row", F.lit(0).cast("long"), lambda acc, n: acc + n)
    cells = rows.select(*by, "true", total.alias("_total"), F.posexplode("_row").alias("pred", "n"))
    return cells.select(*by, "true", "pred", "n", share(F.col("n"), F.col("_total")).alias("row_share"))


def confusion_wide(counted: DataFrame, by: list[str] = []) -> DataFrame:
    """SNK8: one row per true stage with a count column per predicted stage."""
    rows = counted.select(*by, F.posexplode("cm").alias("true", "_row"))
    return rows.select(
        *by,
        "true",
        *[F.col("_row")[j].alias(f"pred_{name}") for j, name in enumerate(S.STAGE_NAMES)],
    )


def per_class(counted: DataFrame, by: list[str] = []) -> DataFrame:
    """AGG8 in long form: ``stage``, ``name``, ``precision``, ``recall``, ``f1``, ``support``."""
    return counted.select(*by, F.posexplode("scores").alias("stage", "_s")).select(
        *by, "stage", stage_name(F.col("stage")).alias("name"), "_s.*"
    )


def headline(counted: DataFrame, by: list[str] = []) -> DataFrame:
    """AGG9-AGG11: ``n_epochs``, ``accuracy``, ``macro_f1``, ``cohen_kappa``."""
    return counted.select(*by, "n_epochs", "accuracy", "macro_f1", "cohen_kappa")


def metrics_document(counted: DataFrame, by: list[str] = []) -> DataFrame:
    """AGG17: every metric of a group as one nested row, in document order."""
    names = F.array(*[F.lit(n) for n in S.STAGE_NAMES])
    stages = ", ".join(f"'{name}', scores[{i}]" for i, name in enumerate(S.STAGE_NAMES))
    return counted.select(
        *by,
        "accuracy",
        "macro_f1",
        "cohen_kappa",
        F.expr(f"named_struct({stages})").alias("per_stage"),
        F.col("cm").alias("confusion_matrix"),
        names.alias("class_names"),
        "n_epochs",
    )


def metrics_text(stats: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """FN15: a readable line of metrics per recording of ``stats``, another where no expert scored it.

    ``metrics`` are rows of :func:`metrics_document` by ``keys``.
    """
    fixed = lambda value, places: F.when(value.isNull() | F.isnan(value), F.lit("—")).otherwise(
        F.format_string(f"%.{places}f", F.bround(F.round(value, 9), places))
    )
    per_stage = F.concat_ws(
        " · ", *[F.concat(F.lit(f"{n} "), fixed(F.col(f"per_stage.{n}.f1"), 2)) for n in S.STAGE_NAMES]
    )
    line = F.concat(
        F.lit("accuracy "),
        fixed(F.col("accuracy") * 100, 1),
        F.lit("%, macro-F1 "),
        fixed(F.col("macro_f1"), 3),
        F.lit(", kappa "),
        fixed(F.col("cohen_kappa"), 3),
        F.lit(" over "),
        F.col("n_epochs").cast("string"),
        F.lit(" scored epochs; F1 by stage: "),
        per_stage,
    )
    lines = metrics.select(*keys, line.alias("metrics"))
    return stats.select(*keys).join(lines, keys, "left").select(
        *keys, F.coalesce("metrics", F.lit("no expert scoring to compare with")).alias("metrics")
    )


def scored_only(df: DataFrame, expert: str) -> DataFrame:
    """FLT10: rows an expert has scored."""
    return df.filter(F.col(expert).isNotNull() & (F.col(expert) != S.UNSCORED))


def compare_models(counted: DataFrame, models: list[str]) -> DataFrame:
    """AGG19: one row per metric, one column per model (``counted`` is grouped by ``model``)."""
    scores = [(name, F.col(name)) for name in ("accuracy", "macro_f1", "cohen_kappa")]
    scores += [(f"f1_{n}", F.col("scores")[i]["f1"]) for i, n in enumerate(S.STAGE_NAMES)]
    long = counted.select(
        "model",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in scores])
        ).alias("_m"),
    ).select("model", "_m.*")
    return long.groupBy("metric").pivot("model", models).agg(F.first("value"))


def scorer_parity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """AGG18: two scorers on the same epochs: label differences, largest probability gap."""
    gap = F.array_max(F.zip_with("_pa", "_pb", lambda x, y: F.abs(x - y)))
    left = a.select(*keys, F.col("pred").alias("_a"), F.col("proba").alias("_pa"))
    right = b.select(*keys, F.col("pred").alias("_b"), F.col("proba").alias("_pb"))
    return left.join(right, keys).agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.count_if(F.col("_a") != F.col("_b")).alias("label_diffs"),
        F.max(gap).alias("max_gap"),
    )

"""Checks that evaluate: indicator texts become typed predicates, which are
joined to rows as data (RU-6..RU-8, JN-8, AG-26).

An indicator opens with a clause over a known feature or is left to a person:

* numeric: ``feature op number`` (``>= > <= < == != =``, also the signs for at
  least and at most; ``$`` and thousands commas allowed), not a multiple or a
  share (``5x``, ``3%``);
* categorical: ``feature in {a, b}`` (any brackets), ``feature = a``,
  ``feature == a``, ``feature is a``, quotes allowed;
* manual: anything else, and clauses over features that nobody knows.

A pattern's checks travel as one array, so rows meet them in a single join and
are evaluated in place; features are not unpivoted.  Status: present, absent,
unknown (the row has no value), manual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("present", "absent", "manual", "unknown")
_NAME = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*"
NUMERIC_RE = _NAME + r"(>=|<=|≥|≤|==|!=|=|>|<)\s*\$?(-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?)(?![0-9A-Za-z_%]|[.,][0-9])"
IN_RE = _NAME + r"\s+in\s*[\(\[\{]([^\)\]\}]+)[\)\]\}]"
IS_RE = _NAME + r"(?:==?|\s+is\s)\s*['\"]?([^'\"\s,;]+)['\"]?"


def compile_checks(df: DataFrame, numeric: list[str], categorical: list[str], text: str = "indicator") -> DataFrame:
    """RU-7: ``df`` with check_type, feature, operator, value (double) and
    ``values`` (strings) of each indicator text (null text: manual)."""
    t = F.coalesce(F.col(text), F.lit(""))
    num, of, is_ = (F.regexp_extract(t, r, 1) for r in (NUMERIC_RE, IN_RE, IS_RE))
    op = F.regexp_extract(t, NUMERIC_RE, 2)
    op = F.when(op == "=", "==").when(op == "≥", ">=").when(op == "≤", "<=").otherwise(op)
    value = F.replace(F.regexp_extract(t, NUMERIC_RE, 3), F.lit(","), F.lit("")).try_cast("double")
    listed = F.transform(F.split(F.regexp_extract(t, IN_RE, 2), ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    listed = F.filter(listed, lambda x: x != "")
    is_num, is_in, is_one = num.isin(numeric), of.isin(categorical), is_.isin(categorical)
    kind = F.when(is_num, "numeric").when(is_in | is_one, "categorical").otherwise("manual")
    return (df.withColumn("check_type", kind)
            .withColumn("feature", F.when(is_num, num).when(is_in, of).when(is_one, is_))
            .withColumn("operator", F.when(is_num, op))
            .withColumn("value", F.when(is_num, value))
            .withColumn("values", F.when(~is_num & is_in, listed).when(~is_num & is_one, F.array(F.regexp_extract(t, IS_RE, 2)))))


def pattern_checks(checks: DataFrame, pattern: str = "pattern_id", order: str = "check_id") -> DataFrame:
    """One row per pattern with its checks in order (a pattern has a handful)."""
    one = F.struct(F.col(order).cast("long").alias("check_id"), "check_type", "feature", "operator", "value", "values")
    return checks.groupBy(pattern).agg(F.sort_array(F.collect_list(one)).alias("checks"))


def _status(c: Column, number: Column, word: Column) -> Column:
    value = c["value"]
    holds = (F.when(c["operator"] == ">=", number >= value).when(c["operator"] == ">", number > value)
             .when(c["operator"] == "<=", number <= value).when(c["operator"] == "<", number < value)
             .when(c["operator"] == "==", number == value).when(c["operator"] == "!=", number != value))
    numeric = F.when(number.isNull() | F.isnan(number) | holds.isNull(), "unknown").when(holds, "present").otherwise("absent")
    categorical = (F.when(word.isNull(), "unknown").when(F.array_contains(c["values"], word), "present").otherwise("absent"))
    return (F.when(c["check_type"] == "numeric", numeric).when(c["check_type"] == "categorical", categorical).otherwise("manual"))


def evaluate(rows: DataFrame, checks: DataFrame, numeric: list[str], categorical: list[str], pattern: str = "pattern_id") -> DataFrame:
    """RU-8 / JN-8: ``rows`` (with their pattern) and ``checks``, the evaluated
    checks of that pattern; a row without a pattern, or whose pattern has no
    checks, has none.  Adaptive execution picks the join by the pattern table's size."""
    have = set(rows.columns)

    def table(names: list[str], kind: str) -> Column:
        known = [n for n in names if n in have]
        if not known:
            return F.lit(None).cast(f"map<string,{kind}>")
        return F.map_from_arrays(F.array(*[F.lit(n) for n in known]), F.array(*[F.col(n).cast(kind) for n in known]))

    per = pattern_checks(checks, pattern)
    wide = rows.withColumn("_num", table(numeric, "double")).withColumn("_cat", table(categorical, "string"))
    wide = wide.join(per, pattern, "left")

    def run(c: Column) -> Column:
        number, word = F.element_at("_num", c["feature"]), F.element_at("_cat", c["feature"])
        return F.struct(c["check_id"].alias("check_id"), c["check_type"].alias("check_type"), c["feature"].alias("feature"),
                        _status(c, number, word).alias("status"), number.alias("actual"), word.alias("actual_text"))

    none = F.array().cast("array<struct<check_id:bigint,check_type:string,feature:string,status:string,actual:double,actual_text:string>>")
    return wide.withColumn("checks", F.coalesce(F.transform("checks", run), none)).drop("_num", "_cat")


def check_rows(evaluated: DataFrame, id_col: str = "txn_id") -> DataFrame:
    """One row per transaction and check."""
    return evaluated.select(id_col, F.explode("checks").alias("c")).select(id_col, "c.*")


def check_summary(evaluated: DataFrame) -> DataFrame:
    """AG-26: counts by status and the overlap tier:

    no_signals (nothing to verify), insufficient (nothing checkable), strong (3
    or more present, and more than absent), defining (the first check is present,
    others are absent), mixed (some present), no_fit (2 or more absent),
    inconclusive."""
    def having(status: str) -> Column:
        return F.size(F.filter("checks", lambda c: c["status"] == status)).cast("long")

    out = evaluated.withColumns({s: having(s) for s in STATUSES})
    present, absent = F.col("present"), F.col("absent")
    first = F.try_element_at("checks", F.lit(1))["status"] == "present"
    tier = (F.when(F.size("checks") == 0, "no_signals").when(present + absent == 0, "insufficient")
            .when((present >= 3) & (present > absent), "strong").when(first & (absent > 0), "defining")
            .when(present > 0, "mixed").when(absent >= 2, "no_fit").otherwise("inconclusive"))
    return out.withColumn("tier", tier)


class TooFewRows(ValueError):
    """Fewer rows than a rule may be drawn from."""


def rule_input_set(df: DataFrame, days: int = 30, band: str = "high_critical", min_rows: int = 5,
                   factor: int = 5, score: str = "score", t: str = "t") -> DataFrame:
    """RU-6: the rows that rules are drawn from: those of the last ``days`` days
    in ``band`` with up to ``factor`` times as many others (``all``: every row
    of these days).  Fewer than ``min_rows`` rows in all are refused."""
    from riskflow.functions.bands import band_predicate, last_n_days
    from riskflow.operators.sampling import baseline_sample
    from riskflow.session import materialize
    recent = last_n_days(df, days, t)
    out = materialize(recent if band == "all" else baseline_sample(recent, band_predicate(band, score), factor), "rule-input")
    n = out.limit(min_rows).count()
    if n < min_rows:
        raise TooFewRows(f"{n} of at least {min_rows} rows")
    return out

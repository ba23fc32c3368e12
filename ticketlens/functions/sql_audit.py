"""Rules for SQL that was written by someone else: one SELECT over the allowed relations, capped.

``audit`` judges a whole column of logged statements; ``check_statement`` judges a single one
with the same expressions before it is run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.fixed_values import ALLOWED_RELATIONS, FORBIDDEN_SQL, MAX_LIMIT
from ticketlens.functions.text import strip_space

# The shapes the rules look for.
LINE_COMMENT = r"--[^\n]*"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
READ_START = r"(?i)^(select|with)\b"
FORBIDDEN = r"(?i)\b(" + "|".join(FORBIDDEN_SQL) + r")\b"
RELATION = r"(?i)\b(?:from|join)\s+([a-zA-Z_][\w.]*)"
CTE_NAME = r"(?i)(?:\bwith|,)\s*([a-zA-Z_]\w*)\s+as\s*\("
FINAL_LIMIT = r"(?i)\blimit\s+(\d+)\s*$"
JVM_CALL = r"(?i)\b(reflect|try_reflect|java_method|identifier)`?\s*\("

# What the analysed plan of a statement may consist of, by class: everything else is refused.
PLAN_NODES = frozenset("""
    Aggregate CTERelationDef CTERelationRef Distinct Except Expand Filter GlobalLimit Intersect Join
    LateralJoin LocalLimit OneRowRelation Project Sort SubqueryAlias Union Window WithCTE
""".split())
EXPRESSIONS = frozenset("""
    Abs Add AggregateExpression Alias And AttributeReference Average Between CaseWhen Cast Ceil CeilExpressionBuilder
    Coalesce CommonExpressionDef CommonExpressionRef Concat ConcatWs Contains Count CountIf CurrentDate
    CurrentRow$ CurrentTimestamp DateAdd DateAddInterval DateDiff DateFormatClass DateSub DatetimeSub DayOfMonth
    DayOfWeek DayOfYear DenseRank Divide EndsWith EqualNullSafe EqualTo Exists Extract FirstValue First Floor
    GreaterThan GreaterThanOrEqual Greatest GroupingID Hour If In InSubquery IntegralDivide IsNotNull IsNull Lag Last
    LastDay LateralSubquery Lead Least Left Length LessThan LessThanOrEqual Like ListQuery Literal Lower
    Max MaxBy Median Min MinBy Minute Month MonthsBetween Multiply NTile Not NullIf Nvl Or OuterReference
    ParseToDate ParseToTimestamp PercentRank Percentile PercentileCont Pow Quarter RLike Rank Remainder Right
    Round RowNumber ScalarSubquery Second SortOrder SpecifiedWindowFrame Sqrt StartsWith StddevPop StddevSamp
    StringReplace StringTrim StringTrimLeft StringTrimRight Substring Subtract SubtractDates
    SubtractTimestamps Sum TimestampAddInterval TruncDate TruncTimestamp TryDivide TypedNullLiteral UnaryMinus
    UnboundedFollowing$ UnboundedPreceding$ Upper VariancePop VarianceSamp WeekDay WeekOfYear
    WindowExpression WindowSpecDefinition With Year
""".split())


class UnsafeStatement(ValueError):
    """The statement breaks a rule; the message says which."""


def _cleaned(sql: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(sql, LINE_COMMENT, " "), BLOCK_COMMENT, " ")
    return strip_space(F.regexp_replace(strip_space(bare), ";+$", ""))


def audit(statements: DataFrame, sql: str = "stmt") -> DataFrame:
    """Adds ``ok``, ``reason`` (NULL when ok) and ``safe_sql`` (NULL when not ok)."""
    text = F.col("_clean")
    keyword = F.upper(F.regexp_extract(text, FORBIDDEN, 1))
    ctes = F.transform(F.regexp_extract_all(text, F.lit(CTE_NAME), 1), F.lower)
    allowed = F.concat(F.array(*[F.lit(r) for r in ALLOWED_RELATIONS]), F.col("_ctes"))
    relations = F.regexp_extract_all(text, F.lit(RELATION), 1)
    foreign = F.filter(relations, lambda r: ~F.array_contains(F.col("_allowed"), F.lower(r)))
    limit = F.regexp_extract(text, FINAL_LIMIT, 1)
    # A number too long for the type is above the maximum whatever its value.
    above = F.coalesce(limit.try_cast("decimal(38,0)") > MAX_LIMIT, F.lit(True))
    capped = (
        F.when(limit == "", F.concat(text, F.lit(f" LIMIT {MAX_LIMIT}")))
        .when(above, F.regexp_replace(text, FINAL_LIMIT, f"LIMIT {MAX_LIMIT}"))
        .otherwise(text)
    )
    reason = (
        F.when(text == "", "empty query")
        .when(F.contains(text, F.lit(";")), "multiple statements are not allowed")
        .when(~F.rlike(text, F.lit(READ_START)), "only SELECT queries are allowed")
        .when(keyword != "", F.concat(F.lit("forbidden keyword: "), keyword))
        .when(F.size("_foreign") > 0,
              F.concat(F.lit("relation not allowed: "), F.get("_foreign", F.lit(0))))
    )
    return (
        statements.withColumn("_clean", _cleaned(F.col(sql)))
        .withColumn("_ctes", ctes)
        .withColumn("_allowed", allowed)
        .withColumn("_foreign", foreign)
        .withColumn("reason", reason)
        .withColumn("ok", F.col("reason").isNull())
        .withColumn("safe_sql", F.when(F.col("ok"), capped))
        .drop("_clean", "_ctes", "_allowed", "_foreign")
    )


def check_statement(spark: SparkSession, sql: str) -> str:
    """The capped statement, or ``UnsafeStatement``."""
    row = audit(spark.createDataFrame([(sql,)], "stmt string")).first()
    if not row["ok"]:
        raise UnsafeStatement(row["reason"])
    calls = spark.createDataFrame([(row["safe_sql"],)], "q string")
    if calls.filter(F.rlike("q", F.lit(JVM_CALL))).count():
        raise UnsafeStatement("calls into the JVM and computed names are not allowed")
    return row["safe_sql"]

"""GEMM benchmark commands and logs: parameters, results and comparison."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import sql_text

# Command flags: column, flag and the value when absent (fixed values).
ROCBLAS_FLAGS = [("m", "-m"), ("n", "-n"), ("k", "-k"), ("transA", "--transposeA"), ("transB", "--transposeB"),
                 ("alpha", "--alpha"), ("beta", "--beta"), ("lda", "--lda"), ("ldb", "--ldb"), ("ldc", "--ldc"),
                 ("ldd", "--ldd"), ("a_type", "--a_type"), ("b_type", "--b_type"), ("c_type", "--c_type"),
                 ("d_type", "--d_type"), ("compute_type", "--compute_type")]
HIPBLASLT_FLAGS = [("m", "-m"), ("n", "-n"), ("k", "-k"), ("transA", "--transA"), ("transB", "--transB"),
                   ("batch_count", "--batch_count"), ("a_type", "--a_type"), ("b_type", "--b_type"), ("c_type", "--c_type"),
                   ("d_type", "--d_type"), ("compute_type", "--compute_type"), ("activation_type", "--activation_type"),
                   ("scaleA", "--scaleA"), ("scaleB", "--scaleB")]
DEFAULTS = {"batch_count": "1", "activation_type": "none", "scaleA": "0", "scaleB": "0"}


# Fixed value: a flag of a benchmark command and the word after it.
FLAG_VALUE = r"(?:^|\s)%s\s+(\S+)"

def _flag(column: str, flag: str) -> str:
    value = f"nullif(regexp_extract(command, {sql_text(FLAG_VALUE % flag)}, 1), '')"
    return f"coalesce({value}, '{DEFAULTS[column]}') AS {column}" if column in DEFAULTS else f"{value} AS {column}"


def commands(lines: DataFrame) -> DataFrame:
    """Command rows of a case file: blank and comment lines dropped, a leading count removed."""
    return lines.filter(r"text RLIKE '\\S' AND NOT text RLIKE '^\\s*#'").withColumn(
        "command", F.expr(r"regexp_replace(text, '^\\s*[0-9]*\\s*', '')"))


def rocblas_cases(lines: DataFrame) -> DataFrame:
    """Parameters of rocBLAS commands ``(line, text)``."""
    return commands(lines).selectExpr("line", *[_flag(c, f) for c, f in ROCBLAS_FLAGS])


def hipblaslt_cases(lines: DataFrame) -> DataFrame:
    """Parameters of hipBLASLt commands ``(line, text)``."""
    return commands(lines).selectExpr("line", *[_flag(c, f) for c, f in HIPBLASLT_FLAGS],
                                      "IF(contains(command, '--bias_vector'), '1', '0') AS bias_vector")


def log_results(logs: DataFrame) -> DataFrame:
    """Throughput, time and kernel of each log ``(line, variant, line_no, text)``.

    The last result line and the last kernel name count. A named solution goes before a kernel symbol.
    """
    parsed = logs.selectExpr(
        "line", "variant", "line_no", r"IF(text RLIKE '^[NT],|^\\s+[A-Z],', split(text, ','), NULL) AS f",
        r"try_element_at(regexp_extract_all(text, 'Solution::(\\S+)', 1), -1) AS solution",
        r"try_element_at(regexp_extract_all(text, '\\b(Cij\\S*)', 1), -1) AS symbol",
        r"nullif(regexp_extract(text, 'kernel name:\\s*(\\S+)', 1), '') AS named")
    last = "max_by({c}, IF({c} IS NULL, NULL, line_no))"
    return parsed.groupBy("line", "variant").agg(
        F.expr(f"{last.format(c='f')} AS f"), F.expr(f"{last.format(c='named')} AS named"),
        F.expr(f"{last.format(c='solution')} AS solution"), F.expr(f"{last.format(c='symbol')} AS symbol")).selectExpr(
        "line", "variant", "coalesce(named, solution, symbol) AS kernel", "try_cast(trim(try_element_at(f, -2)) AS DOUBLE) AS gflops",
        "try_cast(trim(try_element_at(f, -1)) AS DOUBLE) AS us")


def compare(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases with baseline and optimised results; percentages to two decimals, NULL where either side is missing."""
    sides = results.groupBy("line").agg(*[
        F.expr(f"any_value(IF(variant = '{v}', {c}, NULL), TRUE) AS {v}_{c}")
        for v in ("baseline", "optimized") for c in ("kernel", "gflops", "us")])
    pct = "floor(try_divide({a}, {b}) * 100D * 100D + 0.5D) / 100D"
    return cases.join(sides, "line", "left").withColumns({
        "gflops_pct": F.expr(pct.format(a="optimized_gflops", b="baseline_gflops")),
        "us_pct": F.expr(pct.format(a="baseline_us", b="optimized_us"))}).withColumn(
        "case_group", F.expr("IF(transA = 'T', 'TransA=T, TransB=N', concat('TransA=N, TransB=N, n=', n))"))


def statistics(compared: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean, extreme and improved/regressed/unchanged counts of the throughput percentage."""
    return compared.filter("gflops_pct IS NOT NULL").groupBy(*(keys or [])).agg(
        F.expr("count(1) AS case_count"), F.expr("sum(CAST(round(gflops_pct * 100) AS BIGINT)) / count(1) / 100D AS mean_pct"),
        F.expr("max(gflops_pct) AS max_pct"), F.expr("min(gflops_pct) AS min_pct"), F.expr("count_if(gflops_pct > 100) AS improved"),
        F.expr("count_if(gflops_pct < 100) AS regressed"), F.expr("count_if(gflops_pct = 100) AS unchanged"))

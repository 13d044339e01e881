"""Reading and writing plain-text documents with a header block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, headings, let, lit_or_col, strip
from ..rules import domain as D

RULE = "=" * 20


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def header_struct(c, keys=D.HEADER_KEYS, max_lines: int = D.HEADER_MAX_LINES) -> Column:
    """STRUCT(headers MAP, body) of a text that may open with a ``KEY: value`` block.

    Header lines run to the first rule line or the first line that is neither
    blank nor a header. Lines with a colon count as headers only among the first
    ``max_lines``. Of a repeated key the last value is taken.
    """
    text = lit_or_col(c)

    def marked(lines):
        trimmed = F.transform(lines, strip)
        kinds = F.transform(
            trimmed,
            lambda s, i: F.when(s.startswith(RULE), "rule")
            .when(s.contains(":") & (i < max_lines), "header")
            .when((s == "") | s.startswith("="), "blank")
            .otherwise("body"),
        )
        return F.struct(lines.alias("lines"), trimmed.alias("trimmed"), kinds.alias("kinds"))

    def located(m):
        rule, body = F.array_position(m["kinds"], "rule"), F.array_position(m["kinds"], "body")
        at_rule = (rule > 0) & ((body == 0) | (rule < body))
        return F.struct(
            m["lines"].alias("lines"), m["trimmed"].alias("trimmed"), m["kinds"].alias("kinds"),
            F.when(at_rule, rule - 1).when(body > 0, body - 1).otherwise(F.size(m["lines"])).cast("int").alias("n_head"),
            F.when(at_rule, rule).when(body > 1, body - 1).otherwise(0).cast("int").alias("start"),
        )

    def result(m):
        zipped = F.arrays_zip(m["trimmed"].alias("s"), m["kinds"].alias("k"))
        head = F.filter(F.slice(zipped, F.lit(1), m["n_head"]), lambda z: z["k"] == "header")
        pairs = F.filter(
            F.transform(
                head,
                lambda z: F.struct(
                    F.lower(strip(F.substring_index(z["s"], ":", 1))).alias("key"),
                    strip(F.substr(z["s"], F.instr(z["s"], ":") + 1)).alias("value"),
                ),
            ),
            lambda p: p["key"].isin(*keys),
        )
        rest = strip(F.array_join(F.slice(m["lines"], m["start"] + 1, F.size(m["lines"])), "\n"))
        return F.struct(
            let(let(pairs, _last_of_key), _title_from_policy).alias("headers"),
            F.when(m["start"] > 0, rest).otherwise(text).alias("body"),
        )

    return let(let(let(F.split(text, "\n"), marked), located), result)


def _last_of_key(pairs: Column) -> Column:
    keys = F.transform(pairs, lambda p: p["key"])
    later = lambda i: F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1)))
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(later(i), p["key"]) == 0))


def _title_from_policy(headers: Column) -> Column:
    has = lambda k: F.coalesce(F.element_at(headers, k), F.lit("")) != ""
    renamed = F.map_concat(
        F.map_filter(headers, lambda k, v: k != "title"), F.create_map(F.lit("title"), F.element_at(headers, "policy_title"))
    )
    return F.when(has("policy_title") & ~has("title"), renamed).otherwise(headers)


def parse_documents(df: DataFrame) -> DataFrame:
    """Adds headers, cleaned body, title, headings and page count to (…, filename, text)."""
    parsed = df.withColumn("_h", header_struct("text"))
    body = clean_text(F.col("_h.body"))
    title = F.nullif(F.element_at("_h.headers", "title"), F.lit(""))
    return (
        parsed.withColumn("headers", F.col("_h.headers"))
        .withColumn("title", F.coalesce(title, F.replace(F.substring_index("filename", "/", -1), F.lit(".txt"), F.lit(""))))
        .withColumn("text", body)
        .withColumn("headings", headings("text"))
        .withColumn("total_pages", F.lit(1))
        .drop("_h")
    )


def serialise(title, source, url, doc_type, content, metadata=None) -> Column:
    """Header lines, a rule and the content: the form ``header_struct`` reads back."""
    fixed = [
        F.concat(F.lit(name + ": "), F.coalesce(lit_or_col(c), F.lit("None")))
        for name, c in (("TITLE", title), ("SOURCE", source), ("URL", url), ("DOC_TYPE", doc_type))
    ]
    parts = list(fixed)
    if metadata is not None:
        extra = F.transform(
            F.map_entries(lit_or_col(metadata)), lambda e: F.concat(F.upper(e["key"]), F.lit(": "), e["value"])
        )
        parts.append(F.nullif(F.array_join(extra, "\n"), F.lit("")))
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n\n" + "=" * 60 + "\n\n"), lit_or_col(content))


def write_texts(df: DataFrame, path: str, text: str = "text", filename: str = "filename") -> None:
    """One folder and file per file name, the form ``read_text_files`` reads back document by document."""
    named = df.select(F.col(text).alias("value"), F.col(filename).alias("filename"))
    named.repartition("filename").write.mode("overwrite").partitionBy("filename").text(path)

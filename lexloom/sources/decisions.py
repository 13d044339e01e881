"""Court search results and decision records from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import lookup
from ..functions.text import any_contains, let, lit_or_col, strip
from ..functions.topics import outcome
from ..rules import domain as D

RESULT_SCHEMA = (
    "caseName string, caseNameFull string, case_name string, cluster_id string, id string, court_id string, court string, "
    "dateFiled string, date_filed string, dateDecided string, date_decided string, citation array<string>, "
    "neutralCite string, lexisCite string, docketNumber string, snippet string, syllabus string, "
    "opinions array<struct<id:string,snippet:string>>, absolute_url string, "
    "meta struct<score:struct<bm25:double>>, plain_text string, html string"
)


def _first(r: Column, *names) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(r[n], F.lit("")) for n in names])


def drop_tags(c: Column, by: str = "") -> Column:
    return F.regexp_replace(c, "<[^>]+>", by)


def _shared(r: Column, base_url: str):
    name = _first(r, "caseName", "caseNameFull")
    case_id = F.coalesce(_first(r, "cluster_id", "id"), F.lit(""))
    path = _first(r, "absolute_url")
    url = F.coalesce(
        F.concat(F.lit(base_url), path), F.concat(F.lit(f"{base_url}/opinion/"), case_id, F.lit("/"))
    )
    snippet = F.coalesce(
        _first(r, "snippet"), F.nullif(F.try_element_at(r["opinions"], F.lit(1))["snippet"], F.lit(""))
    )
    return name, case_id, url, strip(drop_tags(snippet))


def parse_search_results(df: DataFrame, json_col: str = "result", base_url: str = D.COURT_BASE_URL,
                         topic_words=D.COURT_TOPIC_WORDS, outcomes=D.COURT_OUTCOMES, summary_chars: int = 300) -> DataFrame:
    """One flat row per search result; each value comes from the first key that has one.

    ``summary`` shows the opening of the snippet; ``search_text`` is all of it, and topics and outcome come from it.
    """
    def flat(c):
        name, case_id, url, snippet = _shared(c, base_url)
        summary = let(snippet, lambda s: F.nullif(
            F.when(F.length(s) > summary_chars, F.concat(F.left(s, F.lit(summary_chars)), F.lit("..."))).otherwise(s), F.lit("")
        ))
        court = F.coalesce(_first(c, "court_id", "court"), F.lit(""))
        return F.struct(
            F.coalesce(name, _first(c, "case_name"), F.lit("Unknown Case")).alias("case_name"), case_id.alias("case_id"),
            court.alias("court"), F.coalesce(lookup(court, D.COURT_NAMES), c["court"], F.lit("Federal Court")).alias("court_name"),
            _first(c, "dateFiled", "date_filed", "dateDecided", "date_decided").alias("date_decided"),
            F.coalesce(
                F.nullif(F.try_element_at(c["citation"], F.lit(1)), F.lit("")),
                _first(c, "neutralCite", "lexisCite", "docketNumber"),
            ).alias("citation"),
            summary.alias("summary"), F.coalesce(snippet, F.lit("")).alias("search_text"), url.alias("url"), F.coalesce(c["meta"]["score"]["bm25"], F.lit(0.5)).alias("prior"),
        )

    none = F.array().cast("array<string>")
    text = F.lower(F.concat(F.col("_f.case_name"), F.lit(" "), F.col("_f.search_text")))
    topics = let(text, lambda t: F.filter(
        F.array(*[F.when(any_contains(t, ws), F.lit(name)) for name, ws in topic_words.items()]) if topic_words else none,
        lambda x: x.isNotNull(),
    ))
    others = [x for x in df.columns if x != json_col]
    return df.withColumn("_f", let(F.from_json(json_col, RESULT_SCHEMA), flat)).select(
        *others, "_f.*", topics.alias("case_topics"), outcome(F.col("_f.search_text"), outcomes).alias("outcome")
    )


def opinion_text(plain, html, min_plain: int = 500, limit: int | None = None) -> Column:
    """Plain text above ``min_plain`` characters, else the page without tags; whole unless ``limit`` cuts it."""
    plain, html = F.coalesce(lit_or_col(plain), F.lit("")), F.coalesce(lit_or_col(html), F.lit(""))
    text = F.when(F.length(plain) > min_plain, plain).otherwise(drop_tags(html, " "))
    return text if limit is None else F.left(text, F.lit(limit))


def parse_decisions(df: DataFrame, source_type: str, json_col: str = "result", base_url: str = D.COURT_BASE_URL,
                    min_chars: int = 100, outcomes=D.DECISION_OUTCOMES) -> DataFrame:
    """(…, url, title, content, outcome) per decision: header block, syllabus, opinion or excerpt."""
    label = source_type.upper()

    def flat(c):
        name, case_id, url, snippet = _shared(c, base_url)
        return F.struct(
            F.coalesce(name, F.lit("Unknown Case")).alias("name"), case_id.alias("case_id"), url.alias("url"),
            F.coalesce(snippet, F.lit("")).alias("snippet"),
            F.coalesce(strip(drop_tags(_first(c, "syllabus"))), F.lit("")).alias("syllabus"),
            opinion_text(c["plain_text"], c["html"]).alias("full"),
            F.coalesce(F.try_element_at(c["citation"], F.lit(1)), F.lit("")).alias("citation"),
            F.coalesce(c["court"], F.lit(label)).alias("court"),
            F.coalesce(_first(c, "dateFiled", "date_filed"), F.lit("")).alias("filed"),
        )

    def record(d):
        evidence = F.concat_ws(" ", d["snippet"], d["syllabus"], d["full"])
        return F.struct(
            d["url"].alias("url"), d["case_id"].alias("case_id"),
            F.concat(d["name"], F.lit(" ("), F.coalesce(F.nullif(d["citation"], F.lit("")), d["case_id"]), F.lit(")")).alias("title"),
            d.alias("d"), outcome(evidence, outcomes).alias("outcome"),
        )

    def content(r):
        d, line = r["d"], lambda k, v: F.concat(F.lit(k + ": "), v)
        given = lambda head, v, tail="": F.when(v != "", F.concat(F.lit(head + ":\n"), v, F.lit(tail)))
        return F.concat_ws(
            "\n",
            line("CASE", d["name"]), F.lit(f"SOURCE: {label} Decision"), line("COURT", d["court"]), line("DATE", d["filed"]),
            line("CITATION", d["citation"]), line("OUTCOME", F.coalesce(r["outcome"], F.lit("unknown"))), line("URL", r["url"]),
            F.lit(""), F.lit("=" * 60), F.lit(""), given("SYLLABUS", d["syllabus"], "\n\n"),
            F.coalesce(given("FULL OPINION", d["full"]), given("DECISION EXCERPT", d["snippet"])),
        )

    built = let(let(F.from_json(json_col, RESULT_SCHEMA), flat), record)
    row = let(built, lambda r: F.struct(
        r["url"].alias("url"), r["case_id"].alias("case_id"), r["title"].alias("title"), content(r).alias("content"),
        r["outcome"].alias("outcome"),
    ))
    others = [x for x in df.columns if x != json_col]
    # the length test sits inside the row expression, so that no pushed-down filter builds the text twice
    kept = F.filter(F.array(row), lambda r: F.length(r["content"]) >= min_chars)
    return df.select(*others, F.explode(kept).alias("_d")).select(
        *others, "_d.*", F.lit(source_type).alias("source_type"), F.lit("CASE").alias("doc_type")
    )

"""Display labels, URLs and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import domain as D
from .text import let, lit_or_col


def url_to_filename(c, width: int | None = None) -> Column:
    """File name of a URL, whole unless ``width`` cuts it: names cut short would join pages that differ."""
    bare = F.regexp_replace(lit_or_col(c), "https://|http://", "")
    name = F.regexp_replace(bare, r"(?U)\W", "_")
    return name if width is None else F.left(name, F.lit(width))


def lookup(c, table: dict, default=None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.element_at(m, lit_or_col(c))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def _after(parts: Column, word: str) -> Column:
    """Part that follows the last occurrence of ``word``; null if there is none or it is empty."""
    back = F.array_position(F.reverse(parts), F.lit(word))
    return F.when(back > 1, F.nullif(F.try_element_at(parts, (F.size(parts) - back + 2).cast("int")), F.lit("")))


def manual_label(filename, topic=None, manual: str = D.MANUAL_LABEL, prefix: str = D.MANUAL_FILE_PREFIX,
                 subjects=D.VOLUME_SUBJECTS) -> Column:
    """Readable label of a policy file: manual, volume with subject, part, chapter."""
    filename = F.coalesce(lit_or_col(filename), F.lit(""))
    parts = F.split(F.replace(F.replace(F.lower(filename), F.lit(prefix), F.lit("")), F.lit(".txt"), F.lit("")), "_")
    found = let(parts, lambda p: F.struct(*[_after(p, w).alias(w) for w in ("volume", "part", "chapter")]))

    def text(f):
        subject = F.concat(F.lit(" ("), lookup(F.coalesce(f["volume"], F.lit("")), subjects), F.lit(")"))
        return F.concat_ws(
            " — ", F.lit(manual), F.concat(F.lit("Vol. "), f["volume"], F.coalesce(subject, F.lit(""))),
            F.concat(F.lit("Part "), F.upper(f["part"])), F.concat(F.lit("Ch. "), f["chapter"]),
        )

    words = manual.split(" ", 1)
    topic_col = F.nullif(lit_or_col(topic), F.lit("")) if topic is not None else F.lit(None).cast("string")
    bare = F.coalesce(F.concat(F.lit(words[0] + " "), F.upper(topic_col), F.lit(" " + words[1])), F.lit(manual))
    return F.when(filename == "", bare).otherwise(let(found, text))


def case_label(filename, base_url: str = D.COURT_BASE_URL, placeholder: str = D.CASE_PLACEHOLDER,
               width: int = 80) -> Column:
    """STRUCT(label, url) from a decision's file name."""
    filename = F.coalesce(lit_or_col(filename), F.lit(""))
    name = F.lower(filename)
    source = F.when(name.startswith("aao_"), "AAO").otherwise("BIA")
    bare = name
    for part in D.CASE_FILE_NOISE:
        bare = F.replace(bare, F.lit(part), F.lit(""))

    def after_number(parts):
        number = F.try_element_at(F.filter(parts, lambda p: p.rlike(r"^\d+$")), F.lit(1))
        rest = F.slice(parts, (F.array_position(parts, number) + 1).cast("int"), F.greatest(F.size(parts), F.lit(1)))
        return F.struct(
            number.alias("number"), F.when(number.isNotNull(), rest).otherwise(F.array().cast("array<string>")).alias("rest")
        )

    def result(f):
        number, rest = f["number"], f["rest"]
        slug = F.when(F.size(rest) > 0, F.regexp_replace(F.array_join(rest, "-"), r"^-+|-+$", "")).otherwise("opinion")
        title = F.coalesce(
            F.nullif(F.array_join(F.transform(F.filter(rest, lambda w: w != ""), F.initcap), " "), F.lit("")),
            F.concat(F.lit("Decision "), F.coalesce(number, F.lit(""))),
        )
        label = F.left(F.concat(F.lit("Matter of "), title, F.lit(" ("), source, F.lit(")")), F.lit(width))
        return F.struct(
            F.when(filename == "", F.lit(placeholder)).otherwise(label).alias("label"),
            F.when(filename != "", F.concat(F.lit(f"{base_url}/opinion/"), number, F.lit("/"), slug, F.lit("/"))).alias("url"),
        )

    return let(let(F.split(bare, "_"), after_number), result)


def policy_url(url, title=None, pattern: str = D.CHAPTER_URL_PATTERN, topics=D.VOLUME_PART_TOPICS) -> Column:
    """MAP of header values carried by a chapter URL; keys without value are left out."""
    url = lit_or_col(url)
    none = F.lit(None).cast("string")
    head = F.nullif(F.left(lit_or_col(title), F.lit(200)), F.lit("")) if title is not None else none

    def parts(low):
        number = lambda i: F.regexp_extract(low, pattern, i).try_cast("int").cast("string")
        return F.struct(
            number(1).alias("volume"), F.regexp_extract(low, pattern, 2).alias("part"), number(3).alias("chapter")
        )

    def headers(p):
        found = p["part"] != ""
        only = lambda c: F.when(found, c)
        return F.create_map(
            F.lit("source_url"), url, F.lit("policy_volume"), p["volume"], F.lit("policy_part"), only(p["part"]),
            F.lit("policy_chapter"), p["chapter"], F.lit("visa_type"), only(topic_of_part(p["volume"], p["part"], topics)),
            F.lit("policy_title"), head,
        )

    return F.map_filter(let(let(F.lower(url), parts), headers), lambda k, v: v.isNotNull())


def topic_forms(topic, own, forms=D.TOPIC_FORMS) -> Column:
    """The answer's own forms, then the topic's forms that are not among them."""
    table: dict[str, list[str]] = {}
    for t, _, form, name in sorted(forms, key=lambda f: (f[0], f[1])):
        table.setdefault(t, []).append(f"{form} — {name}")
    m = F.create_map(*[x for t, fs in table.items() for x in (F.lit(t), F.array(*[F.lit(f) for f in fs]))])
    known = F.coalesce(F.element_at(m, F.lower(lit_or_col(topic))), F.array().cast("array<string>"))
    own = F.coalesce(lit_or_col(own), F.array().cast("array<string>"))
    return F.concat(own, F.array_except(known, own))


def topic_of_part(volume, part, topics=D.VOLUME_PART_TOPICS) -> Column:
    return lookup(F.concat_ws("/", lit_or_col(volume).cast("string"), lit_or_col(part)), {f"{v}/{p}": t for v, p, t in topics})

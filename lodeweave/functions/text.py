"""Text, HTML, keyword, licence and URL functions as Column expressions.

All of them stay in the JVM; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The asset types of the catalogue, in the order that breaks ties.
ASSET_TYPES = (
    "datasets", "ml_models", "publications", "case_studies", "educational_resources", "experiments", "services",
    "computational_assets", "resource_bundles", "projects", "events", "news", "organisations",
)
#: Licence families by the prefix they are known by.
LICENCE_PREFIXES = (
    "mit", "apache", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "cc-by-nd", "bsd", "wtfpl", "llama",
    "cc0", "gpl", "agpl", "lgpl", "artistic", "afl", "cdla", "odc", "obdl", "pddl",
)
#: The library's name for each asset type in a link.
LIBRARY_CATEGORIES = {
    "datasets": "Dataset", "ml_models": "AIModel", "publications": "Publication", "case_studies": "Success%20stories",
    "educational_resources": "Educational%20resource", "experiments": "Experiment", "services": "Service",
    "computational_assets": "Computational%20asset", "resource_bundles": "Resource%20Bundle",
}
#: Size units of size categories.
SIZE_UNITS = {"k": 10**3, "m": 10**6, "b": 10**9, "t": 10**12}


def strip_tags(html: Column, by: str = " ") -> Column:
    """HTML with each tag replaced."""
    return F.regexp_replace(html, "<[^>]*>", by)


def text_of(field: Column, plain_only: bool = False) -> Column:
    """Text of a {plain, html} struct: both joined by a space, or plain alone where both are there."""
    html = strip_tags(field["html"])
    if plain_only:
        return F.coalesce(field["plain"], html)
    both = F.concat(field["plain"], F.lit(" "), html)
    return F.coalesce(both, field["plain"], html)


def tokens(text: Column) -> Column:
    """White-space tokens; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def padded(items: Column, size: int, pad: str = "[PAD]") -> Column:
    """{tokens, mask}: the first ``size`` items, filled up with ``pad``; the mask is 1 for items and 0 for what was filled up."""
    own = F.slice(items, 1, size)
    lacking = F.greatest(F.lit(size) - F.size(own), F.lit(0))
    return F.struct(F.concat(own, F.array_repeat(F.lit(pad), lacking)).alias("tokens"), F.concat(F.transform(own, lambda x: F.lit(1)), F.array_repeat(F.lit(0), lacking)).alias("mask"))


def match_terms(text: Column) -> Column:
    """Lower-case letter and digit runs, for text matching."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def text_match(column: Column, value: str) -> Column:
    """Any term of the value occurs in the column."""
    return F.arrays_overlap(match_terms(column), match_terms(F.lit(value)))


def windows(items: Column, size: int, overlap: float, cap: int | None = None) -> Column:
    """Sliding windows over an array: each starts ``int(size * overlap)`` before the end of the last.

    The last window is the first to reach the end; an empty array has one
    empty window. ``cap`` keeps the first so many.
    """
    step = size - int(size * overlap)
    last = F.greatest(F.ceil((F.size(items) - F.lit(size)) / F.lit(step)), F.lit(0)).cast("int")
    if cap is not None:
        last = F.least(last, F.lit(cap - 1))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * step + 1, size))


def stringify_basic(platform: Column, name: Column, description: Column, keywords: Column) -> Column:
    """Platform, name, description and keywords as labelled lines; missing parts give no line."""
    head = F.concat(F.lit("Platform: "), F.coalesce(platform, F.lit("None")), F.lit("\nAsset name: "), F.coalesce(name, F.lit("None")))
    said = F.coalesce(F.concat(F.lit("\nDescription: "), description), F.lit(""))
    words = F.when(F.size(keywords) > 0, F.concat(F.lit("\nKeywords: "), F.array_join(keywords, " | "))).otherwise("")
    return F.concat(head, said, words)


def stringify_relevant(flat: dict[str, Column], arrays: dict[str, Column], blocks: dict[str, Column]) -> Column:
    """Flat fields a line each, a blank line, array fields a line each, a blank line, then blocks of entries.

    ``blocks`` holds arrays of strings, an entry each, that go under an upper-case heading.
    """
    line = lambda k, v: F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\n")), F.lit(""))
    parts = [line(k, v) for k, v in flat.items()] + [F.lit("\n")]
    parts += [F.coalesce(F.when(F.size(v) > 0, F.concat(F.lit(f"{k}: "), F.array_join(v, ", "), F.lit("\n"))), F.lit("")) for k, v in arrays.items()] + [F.lit("\n")]
    for k, v in blocks.items():
        body = F.array_join(F.transform(v, lambda e: F.concat(F.lit("\t"), e, F.lit("\n"))), "")
        parts.append(F.coalesce(F.when(F.size(v) > 0, F.concat(F.lit(f"{k.upper()}:\n"), body)), F.lit("")))
    return F.concat(*parts)


def distribution_lines(distribution: Column) -> Column:
    """An entry of a distribution as ``key:value`` parts, with its size in KB, MB and GB."""
    part = lambda k, v: F.concat(F.lit(f"{k}:"), v.cast("string"))

    def entry(d: Column) -> Column:
        return F.concat_ws(
            ", ", part("name", d["name"]), part("description", d["description"]), part("content_size_kb", d["content_size_kb"]),
            part("encoding_format", d["encoding_format"]), part("content_size_mb", kb_to_mb(d["content_size_kb"])), part("content_size_gb", kb_to_gb(d["content_size_kb"])),
        )

    return F.filter(F.transform(distribution, entry), lambda x: x != "")


def kb_to_mb(kb: Column) -> Column:
    return F.round(kb / F.lit(1024.0), 2)


def kb_to_gb(kb: Column) -> Column:
    return F.round(kb / F.lit(1024.0 * 1024.0), 2)


def keyword_values(keywords: Column, kind: str) -> Column:
    """Distinct values of the keywords ``kind:value`` with exactly one colon, sorted."""
    pairs = F.filter(F.transform(keywords, lambda k: F.split(k, ":")), lambda p: (F.size(p) == 2) & (p[0] == kind))
    return F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p[1])))


def strip_unknown(values: Column) -> Column:
    return F.array_remove(values, "unknown")


def simplify_licence(licence: Column) -> Column:
    """Family of a licence: openrail anywhere, else the longest known prefix, else null."""
    out = F.when(F.contains(licence, F.lit("openrail")), "openrail")
    for prefix in sorted(LICENCE_PREFIXES, key=lambda p: (-len(p), p)):
        out = out.when(F.startswith(licence, F.lit(prefix)), prefix)
    return out


def simplify_licences(licences: Column) -> Column:
    """Family of the first licence, in sorted order, that has one."""
    return F.get(F.filter(F.transform(F.array_sort(licences), simplify_licence), lambda x: x.isNotNull()), F.lit(0))


def size_bound(text: Column) -> Column:
    """A count such as ``10k`` as a number; null for other spellings."""
    number = F.regexp_extract(text, r"^(\d+)([kmbt]?)$", 1)
    unit = F.regexp_extract(text, r"^(\d+)([kmbt]?)$", 2)
    factor = F.lit(1)
    for name, size in SIZE_UNITS.items():
        factor = F.when(unit == name, F.lit(size)).otherwise(factor)
    return F.when(number != "", number.cast("long") * factor.cast("long"))


def size_category(category: Column) -> Column:
    """{lower, upper} of a size category such as ``10k<n<100k``; null if it is none."""
    low, high = size_bound(F.split(category, "<n<")[0]), size_bound(F.get(F.split(category, "<n<"), F.lit(1)))
    both = lambda a, b: F.struct(a.cast("long").alias("lower"), b.cast("long").alias("upper"))
    return (
        F.when(category == "n<1k", both(F.lit(0), F.lit(SIZE_UNITS["k"])))
        .when(category == "n>1t", both(F.lit(SIZE_UNITS["t"]), F.lit(SIZE_UNITS["t"] * 1000)))
        .when(F.contains(category, F.lit("<n<")) & low.isNotNull() & high.isNotNull(), both(low, high))
    )


def closest_type(name: Column, types: tuple[str, ...] = ASSET_TYPES) -> Column:
    """The asset type with the smallest edit distance; the earlier one of equals."""
    ranked = F.array(*[F.struct(F.levenshtein(F.lower(name), F.lit(t)).alias("d"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(types)])
    return F.when(name.isNotNull(), F.array_min(ranked)["t"])


def asset_url(asset_id: Column, asset_type: Column, website: str, library: str, ecosystem: str) -> Column:
    """Link to an asset. A base without a trailing slash loses its last path segment, as in URL joining."""
    base = lambda u: u[: u.rfind("/") + 1] if u.count("/") > 2 else u + "/"
    out = F.when(asset_type == "projects", F.concat(F.lit(base(website) + "project/"), asset_id))
    out = out.when(asset_type.isin("events", "news"), F.concat(F.lit(base(website) + "media-hub/"), asset_id))
    out = out.when(asset_type == "organisations", F.lit(ecosystem))
    for name, category in LIBRARY_CATEGORIES.items():
        out = out.when(asset_type == name, F.concat(F.lit(base(library) + "resources/"), asset_id, F.lit(f"?category={category}")))
    return out


def meta_content(html: Column, name: str) -> Column:
    """``content`` of the first meta tag with this ``property``; empty if there is none."""
    tag = F.regexp_extract(html, rf"(?is)<meta\b(?=[^>]*\bproperty\s*=\s*[\"']{name}[\"'])[^>]*>", 0)
    return F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)


def span_content(html: Column, css_class: str) -> Column:
    """Text of the first span of this class; empty if there is none."""
    inner = F.regexp_extract(html, rf"(?is)<span\b[^>]*\bclass\s*=\s*[\"']{css_class}[\"'][^>]*>(.*?)</span>", 1)
    return strip_tags(inner, "")


def last_modified(html: Column) -> Column:
    """Time of last change a page states: meta tag, else dated span, else empty."""
    span = span_content(html, "git-revision-date-localized-plugin git-revision-date-localized-plugin-datetime")
    return F.coalesce(F.nullif(meta_content(html, "article:modified_time"), F.lit("")), F.nullif(span, F.lit("")), F.lit(""))


def crawlable(html: Column) -> Column:
    """False where a page asks not to be crawled."""
    flag = F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*\bname\s*=\s*[\"']x-dont-crawl[\"'])[^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.lower(F.trim(flag)) != "true"


def page_route(url: Column) -> Column:
    """Which collection a page goes to."""
    return F.when(F.contains(url, F.lit("api")), "api").otherwise("website")


def csv_values(text: Column) -> Column:
    """Lower-case trimmed values of a comma list, blanks dropped."""
    return F.filter(F.transform(F.split(F.lower(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def function_call(text: Column) -> Column:
    """{name, arguments} of ``<function=NAME>{...}</function>``; null if the text has none."""
    pattern = r"(?s)<function=([A-Za-z_]\w*)>(\{.*?\})</function>"
    name = F.regexp_extract(text, pattern, 1)
    return F.when(name != "", F.struct(name.alias("name"), F.regexp_extract(text, pattern, 2).alias("arguments")))


def is_asset_id(text: Column) -> Column:
    return F.rlike(text, F.lit("^[a-z]{3,4}_[a-zA-Z0-9]{24}$"))


def day_key(text: Column) -> Column:
    """Year-month-day without zero padding, as the catalogue's date bounds are written."""
    day = F.to_date(text)
    return F.concat_ws("-", F.year(day), F.month(day), F.dayofmonth(day))


def parse_date(text: Column, default: Column | None = None) -> Column:
    """Timestamp of a catalogue date without its zone, else the default."""
    from lodeweave.operators.units import published_at

    return published_at(text) if default is None else F.coalesce(published_at(text), default)

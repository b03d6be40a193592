"""Text expressions: folding, keys, cleaning, dates and labels. All stay in the JVM, but for searches for many words."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import automaton

#: Words that a plan holds as literals, at most; more are looked for by an automaton.
LITERALS = 500


@cache
def _fold_table() -> tuple[str, str]:
    """Lower-case letters that carry marks, and their bases, by canonical decomposition."""
    marked, base = [], []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c == c.lower() and plain != c and len(plain) == 1:
            marked.append(c)
            base.append(plain)
    return "".join(marked), "".join(base)


def fold(x: Column) -> Column:
    """Case and accents taken away: lower case, canonical bases, no combining marks."""
    return F.regexp_replace(F.translate(F.lower(x), *_fold_table()), r"\p{Mn}+", "")


def fold_all(words: list[str]) -> list[str]:
    """Words folded as texts are, by the session."""
    rows = SparkSession.active().createDataFrame(list(enumerate(words)), "i int, k string").select("i", fold(F.col("k")).alias("k")).collect()
    return [r.k for r in sorted(rows)]


def contains_any(x: Column, keywords: list[str], folded: bool = True) -> Column:
    """Whether any keyword is a substring; blank text and no keywords give false. Many keywords are looked for in one pass."""
    own = fold(x) if folded else F.lower(x)
    low = [k.lower() for k in keywords if k.strip()]
    if len(low) > LITERALS:
        return F.coalesce(automaton.any_of(own, fold_all(low) if folded else low) & (F.trim(x) != ""), F.lit(False))
    hits = [F.contains(own, fold(F.lit(k)) if folded else F.lit(k)) for k in low]
    return F.coalesce(reduce(lambda a, b: a | b, hits, F.lit(False)) & (F.trim(x) != ""), F.lit(False))


def is_relevant(x: Column, keywords: list[str], lemmas: Column | None = None, lemma_keywords: list[str] | None = None) -> Column:
    """The relevance gate: a folded keyword in the text, or a lemma among the keywords' lemmas where lemmas are given."""
    found = contains_any(x, keywords)
    if lemmas is None:
        return found
    own = F.array(*[F.lit(k) for k in lemma_keywords or keywords])
    return found | (F.coalesce(F.arrays_overlap(lemmas, own), F.lit(False)) & F.coalesce(F.trim(x) != "", F.lit(False)))


def content_hash(url: Column, title: Column, stated: Column | None = None) -> Column:
    """SHA-256 of trimmed url, a bar, and the lower-case trimmed title; a stated hash is kept."""
    derived = F.sha2(F.concat(F.trim(url), F.lit("|"), F.lower(F.trim(title))), 256)
    return derived if stated is None else F.coalesce(F.nullif(stated, F.lit("")), derived)


def url_id(url: Column) -> Column:
    return F.left(F.sha2(url, 256), F.lit(32))


def clean_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def strip_source_suffix(title: Column, source: Column) -> Column:
    """The title without a final ' - source', if that is how it ends."""
    end = F.concat(F.lit(" - "), source)
    return F.when(F.endswith(title, end), F.trim(F.left(title, F.length(title) - F.length(end)))).otherwise(title)


def encode_keyword(keyword: Column) -> Column:
    """Percent-encoded, in quotes first if it is a phrase."""
    quoted = F.when(F.contains(keyword, F.lit(" ")), F.concat(F.lit('"'), keyword, F.lit('"'))).otherwise(keyword)
    return F.replace(F.url_encode(quoted), F.lit("+"), F.lit("%20"))


def mail_date(x: Column) -> Column:
    """An RFC 2822 date; the stated offset is dropped and the clock time read as UTC."""
    clock = F.regexp_extract(x, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(F.nullif(clock, F.lit("")), F.lit("d MMM yyyy HH:mm:ss"))


def day(x: Column) -> Column:
    """YYYYMMDD."""
    return F.to_date(F.try_to_timestamp(F.when(F.length(F.trim(x)) == 8, F.trim(x)), F.lit("yyyyMMdd")))


def compact_stamp(x: Column) -> Column:
    """YYYYMMDDTHHMMSSz."""
    return F.try_to_timestamp(F.upper(F.trim(x)), F.lit("yyyyMMdd'T'HHmmssX"))


def iso_stamp(x: Column) -> Column:
    return F.try_to_timestamp(x)


def safe_double(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit("")).try_cast("double")


def safe_int(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit("")).try_cast("int")


def strip_numbering(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"^\d+\.\s*", ""))


def script_share(x: Column, script: str = r"Ͱ-Ͽἀ-῿") -> Column:
    """The share of letters that are of a script; 0 without letters."""
    letters = F.regexp_replace(x, r"[^\p{L}]", "")
    own = F.regexp_replace(letters, f"[^{script}]", "")
    return F.when(F.length(letters) > 0, F.length(own) / F.length(letters)).otherwise(0.0)


def is_greek(x: Column) -> Column:
    return script_share(x) > 0.30


#: Fixed value: the pattern of acronyms in Greek capitals, with dots or in a row, that translation must leave alone.
ACRONYM = r"[\u0391-\u03A9](?:\.[\u0391-\u03A9]){1,}\.?|[\u0391-\u03A9]{2,}(?:\s[\u0391-\u03A9]{1,})*"


def _held(i: Column) -> Column:
    """What stands for the acronym of a number."""
    return F.concat(F.lit("\u27E6"), i.cast("string"), F.lit("\u27E7"))


def mask_acronyms(x: Column) -> Column:
    """struct(text, acronyms): each acronym replaced by a numbered placeholder."""
    parts = F.split(x, ACRONYM, -1)
    last = F.size(parts) - 1
    masked = F.transform(parts, lambda p, i: F.when(i < last, F.concat(p, _held(i))).otherwise(p))
    return F.struct(F.array_join(masked, "").alias("text"), F.regexp_extract_all(x, F.lit(ACRONYM), F.lit(0)).alias("acronyms"))


def restore_acronyms(text: Column, acronyms: Column) -> Column:
    numbered = F.transform(acronyms, lambda a, i: F.struct(_held(i).alias("mark"), a.alias("word")))
    return F.aggregate(numbered, text, lambda t, a: F.replace(t, a["mark"], a["word"]))


def canonical_category(x: Column, categories: list[str]) -> Column:
    """The category equal but for case, else the first whose leading word the text has, else the text itself."""
    own = F.lower(F.trim(x))
    same = [F.when(own == c.lower(), F.lit(c)) for c in categories]
    lead = [F.when(F.contains(F.lower(x), F.lit(c.split()[0].lower())), F.lit(c)) for c in categories]
    return F.coalesce(*same, *lead, x)


def confidence_bucket(x: Column) -> Column:
    return F.when(x > 0.55, "high").when(x > 0.40, "medium").otherwise("low")


def article_text(title: Column, body: Column) -> Column:
    """Title and body in one line; the body alone where there is no title."""
    return F.trim(F.when(F.coalesce(title, F.lit("")) == "", F.coalesce(body, F.lit(""))).otherwise(F.concat_ws(" ", title, body)))


def synthetic_title(kind: Column, place: Column, admin: Column, default: str = "Event") -> Column:
    """'kind in place, admin', leaving out what is missing."""
    where = F.concat_ws(", ", F.nullif(F.trim(place), F.lit("")), F.nullif(F.trim(admin), F.lit("")))
    what = F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit(default))
    return F.when(where == "", what).otherwise(F.concat(what, F.lit(" in "), where))


def bilingual(lang: Column, el: Column, en: Column) -> Column:
    return F.when(lang == "el", el).otherwise(en)


def fenced_json(x: Column) -> Column:
    """The JSON in a reply that may stand in a code fence, as a list of strings; null if it is no JSON.

    Of an object its `locations` are taken, else its `location`, a list or one string; an object with neither gives an empty list.
    """
    bare = F.regexp_replace(F.regexp_replace(x, r"```(?:json)?", ""), r"^\s+|\s+$", "")
    said = F.coalesce(F.get_json_object(bare, "$.locations"), F.get_json_object(bare, "$.location"))
    listed = F.when(F.startswith(said, F.lit("[")), F.from_json(said, "array<string>")).when(said.isNotNull(), F.array(said)).otherwise(F.array().cast("array<string>"))
    return F.when(F.get_json_object(bare, "$").isNotNull() & F.startswith(bare, F.lit("{")), listed).otherwise(_strings(bare))


def _strings(bare: Column) -> Column:
    return F.coalesce(F.from_json(bare, "array<string>"), F.array_compact(F.array(F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>")[0])))


def fixed2(x: Column) -> Column:
    """Two decimals, or a dash for null."""
    return F.when(x.isNull(), "—").otherwise(F.format_string("%.2f", x))


def canonical_url(url: Column) -> Column:
    """The address without fragment and query."""
    return F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"\?.*$", "")


def html_text(html: Column, least: int = 50) -> Column:
    """The main text of a page: its article element if there is one, without scripts, styles and tags; null if short."""
    article = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    body = F.when(article == "", html).otherwise(article)
    for pattern, by in (
        (r"(?is)<(script|style|nav|aside)[^>]*>.*?</(script|style|nav|aside)>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]+>", " "),
        (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;", "'"), (r"&amp;", "&"),
    ):
        body = F.regexp_replace(body, pattern, by)
    text = clean_space(body)
    return F.when(F.length(text) >= least, text)


def search_query(terms: list[str], suffix: str = "") -> str:
    """(a OR "b c" OR d) suffix."""
    return ("(" + " OR ".join(f'"{t}"' if " " in t else t for t in terms) + ") " + suffix).strip()


def search_query_of(terms: Column, suffix: str = "") -> Column:
    """The same of an array of terms in each row."""
    quoted = F.transform(terms, lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
    return F.trim(F.concat(F.lit("("), F.array_join(quoted, " OR "), F.lit(f") {suffix}")))

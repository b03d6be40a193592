"""Ingestion: keys, cleaning, dates, relevance, page text, first occurrences and keyed inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.sources import feeds, sinks

from .bindings import table
from .registry import query

_KEYWORDS = ["und", "License", "été"]
#: The canonical address in SQL.
_URL = "regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '')"


@query("SELECT page_id, sha256(trim(url) || '|' || lower(trim(html))) AS content_hash, left(sha256(url), 32) AS id FROM pages")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content and url keys."""
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", T.content_hash(F.col("url"), F.col("html"), F.lit("")).alias("content_hash"), T.url_id(F.col("url")).alias("id"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """white space collapsed."""
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_space(F.col("text")).alias("clean"))


@query(f"SELECT page_id, {_URL} AS canonical FROM pages")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 stand-in: an address without fragment and query."""
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query("""SELECT p_partkey, CASE WHEN ends_with(t, ' - ' || p_brand) THEN trim(left(t, length(t) - length(' - ' || p_brand))) ELSE t END AS title
 FROM (SELECT *, p_name || ' - ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'Other' END AS t FROM part)""")
def title_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a title without its source's name at the end."""
    title = F.concat_ws(" - ", "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("Other"))
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_source_suffix(title, F.col("p_brand")).alias("title"))


@query(r"""WITH l AS (SELECT doc_id, regexp_replace(text, '[^\p{L}]', '', 'g') AS letters FROM documents)
 SELECT doc_id, round(CASE WHEN length(letters) > 0 THEN length(regexp_replace(letters, '[^à-ÿ]', '', 'g')) / length(letters)::DOUBLE ELSE 0 END, 9) AS share FROM l""")
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the share of letters of a script; here of accented Latin, as the corpus has no Greek."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.script_share(F.col("text"), "à-ÿ"), 9).alias("share"))


@query("""SELECT doc_id, contains(strip_accents(lower(text)), 'und') OR contains(strip_accents(lower(text)), 'license') OR contains(strip_accents(lower(text)), 'ete') AS relevant FROM documents""")
def relevance_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords without regard to case and accents."""
    return table(spark, sf_dir, "documents").select("doc_id", T.is_relevant(F.col("text"), _KEYWORDS).alias("relevant"))


@query("SELECT doc_id, contains(lower(text), 'und') OR contains(lower(text), 'license') OR contains(lower(text), 'été') AS relevant FROM documents")
def relevance_accented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with accents."""
    return table(spark, sf_dir, "documents").select("doc_id", T.contains_any(F.col("text"), _KEYWORDS, folded=False).alias("relevant"))


_HTML = "regexp_replace({}, '{}', '{}', '{}')"


def _html_sql() -> str:
    body = "CASE WHEN regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 'is') = '' THEN html ELSE regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 'is') END"
    steps = [("<(script|style|nav|aside)[^>]*>.*?</(script|style|nav|aside)>", " ", "gis"), ("<!--.*?-->", " ", "gs"), ("<[^>]+>", " ", "g"), ("&nbsp;", " ", "g"), ("&lt;", "<", "g"), ("&gt;", ">", "g"), ("&quot;", '"', "g"), ("&#39;", "''", "g"), ("&amp;", "&", "g"), (r"\s+", " ", "g")]
    for pattern, by, flags in steps:
        body = _HTML.format(body, pattern, by, flags)
    return f"trim({body})"


@query(f"SELECT page_id, CASE WHEN length(t) >= 50 THEN sha256(t) END AS text_hash, CASE WHEN length(t) >= 50 THEN length(t) END AS chars FROM (SELECT page_id, {_html_sql()} AS t FROM pages)")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of a page."""
    rows = table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.sha2("t", 256).alias("text_hash"), F.length("t").cast("long").alias("chars"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each key; the key is hashed so that whole texts need not be shuffled."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("k"))
    return feeds.first_by(rows, ["k"], ["doc_id"]).select("doc_id", "source")


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS n FROM events), k AS (SELECT * FROM c WHERE n <= 15)
 SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY event_id) AS m FROM k) WHERE m = 1""")
def cap_then_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, then R1: a cap for each keyword before duplicates go."""
    rows = table(spark, sf_dir, "events").withColumn("keyword", F.col("user_id") % 40)
    return feeds.first_by(feeds.capped(rows, "keyword", ["event_id"]), ["value"], ["event_id"]).select("event_id", "user_id")


@query(f"""WITH b AS (SELECT page_id, {_URL} AS canonical_url, length(html) AS content_hash FROM pages), s AS (SELECT {_URL} AS canonical_url, length(html) AS content_hash FROM pages WHERE html LIKE '%lang="de"%'),
 h AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY page_id) AS k FROM b), i AS (SELECT * FROM h WHERE k = 1 AND content_hash NOT IN (SELECT content_hash FROM s)),
 u AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY page_id) AS m FROM i)
 SELECT page_id, canonical_url, content_hash FROM u WHERE m = 1 AND canonical_url NOT IN (SELECT canonical_url FROM s)""")
def upsert_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts under two unique keys."""
    rows = table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical_url"), F.length("html").cast("long").alias("content_hash"), F.contains("html", F.lit('lang="de"')).alias("old"))
    return sinks.insert_new(rows.drop("old"), rows.where("old"), ["page_id"])


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS mail, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS number FROM events""")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dates and numbers out of text; what can't be read is null."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss").alias("mail"), F.date_format("ts", "yyyyMMdd").alias("day"), F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("z")).alias("stamp"),
        F.when(F.col("event_id") % 3 == 0, " n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("number"),
    )
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.select("event_id", shown(T.mail_date(F.concat("mail", F.lit(" +0200")))).alias("mail"), F.date_format(T.day(F.col("day")), "yyyy-MM-dd").alias("day"), shown(T.compact_stamp(F.col("stamp"))).alias("stamp"), T.safe_double(F.col("number")).alias("number"))


@query("""SELECT p_partkey, '%22' || replace(p_name, ' ', '%20') || '%22' AS encoded, '(' || split_part(p_name, ' ', 1) || ' OR "' || p_name || '") from:x' AS q,
 'Event in ' || p_brand AS synthetic, trim(p_name || ' ' || p_type) AS article FROM part WHERE contains(p_name, ' ')""")
def text_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encoded keywords, queries, titles and article texts."""
    rows = table(spark, sf_dir, "part").where("contains(p_name, ' ')")
    quoted = F.concat(F.lit("("), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(' OR "'), F.col("p_name"), F.lit('") from:x'))
    return rows.select("p_partkey", T.encode_keyword(F.col("p_name")).alias("encoded"), quoted.alias("q"), T.synthetic_title(F.lit(" "), F.col("p_brand"), F.lit(None).cast("string")).alias("synthetic"), T.article_text(F.col("p_name"), F.col("p_type")).alias("article"))


@query("""SELECT event_id, (props->>'k')::BIGINT AS k, CASE WHEN event_id % 2 = 0 THEN 'Red Alert' WHEN event_type = 'click' THEN 'Click Stream' ELSE event_type END AS category FROM events""")
def json_and_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON fields, fenced replies and canonical categories."""
    said = F.when(F.col("event_id") % 2 == 0, "```json\n[\"it is RED\"]\n```").otherwise(F.concat(F.lit('["'), F.col("event_type"), F.lit('"]')))
    first = F.get(T.fenced_json(said), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), T.canonical_category(first, ["Click Stream", "Red Alert"]).alias("category"))


@query("""SELECT 'documents' AS source, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'benchmark', count(*) FROM benchmark""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of several sources."""
    frames = [table(spark, sf_dir, t).select(F.lit(t).alias("source"), k) for t, k in (("documents", "doc_id"), ("pages", "page_id"), ("benchmark", "item_id"))]
    return feeds.union_all(frames).groupBy("source").agg(F.count("*").alias("n"))


_LATIN, _GREEK = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΑΒ"


@query(f"""WITH g AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS w, translate(upper(split_part(p_name, ' ', 1)), '{_LATIN}', '{_GREEK}') AS a FROM part WHERE contains(p_name, ' '))
 SELECT p_partkey, 'Η ⟦0⟧ ' || w || ' ⟦1⟧ με ⟦2⟧' AS masked, a || '|Κ.Κ.Ε.|ΟΛΜΕ ' || a AS acronyms, 'Η ' || a || ' ' || w || ' Κ.Κ.Ε. με ΟΛΜΕ ' || a AS restored FROM g""")
def acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """acronyms that a translation must leave alone: in a row, with dots, and with further words in capitals; taken out and put back."""
    own = F.translate(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), _LATIN, _GREEK)
    text = F.concat(F.lit("Η "), own, F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" Κ.Κ.Ε. με ΟΛΜΕ "), own)
    rows = table(spark, sf_dir, "part").where("contains(p_name, ' ')").select("p_partkey", T.mask_acronyms(text).alias("m"))
    return rows.select("p_partkey", F.col("m.text").alias("masked"), F.array_join("m.acronyms", "|").alias("acronyms"), T.restore_acronyms(F.col("m.text"), F.col("m.acronyms")).alias("restored"))


@query("""SELECT p_partkey, contains(lower(p_type), 'brass') OR (list_has_any(string_split(lower(p_name), ' '), ['red', 'ring']) AND trim(p_type) <> '') AS relevant,
 CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS shown FROM part""")
def relevance_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by keywords or by the lemmas of a text, and the column of a language."""
    lemmas, lang = F.split(F.lower("p_name"), " "), F.when(F.col("p_size") % 2 == 0, "el").otherwise("en")
    return table(spark, sf_dir, "part").select("p_partkey", T.is_relevant(F.col("p_type"), ["brass"], lemmas, ["red", "ring"]).alias("relevant"), T.bilingual(lang, F.col("p_brand"), F.col("p_name")).alias("shown"))

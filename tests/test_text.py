from pyspark.sql import functions as F

from tidewatch.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fold(spark):
    for text, plain in (("ΔΙΑΔΉΛΩΣΗ", "διαδηλωση"), ("Été Ñandú", "ete nandu"), ("ΐ ΰ ᾅ", "ι υ α"), ("é", "e")):
        assert one(spark, T.fold(F.lit(text))).replace("ς", "σ") == plain.replace("ς", "σ")


def test_relevance(spark):
    words = ["διαδήλωση", "στάση εργασίας", "συμπλοκές"]
    for text, wanted in (
        ("Μεγάλη διαδήλωση στο κέντρο", True), ("ΣΤΑΣΗ ΕΡΓΑΣΙΑΣ αύριο", True), ("μικρές συμπλοκες", True), ("καλός καιρός", False), ("", False), ("  ", False), (None, False),
    ):
        assert one(spark, T.is_relevant(F.lit(text).cast("string"), words)) is wanted
    lemmas = F.array(F.lit("απεργία"))
    assert one(spark, T.is_relevant(F.lit("x"), words, lemmas, ["απεργία"])) is True


def test_content_hash(spark):
    import hashlib

    wanted = hashlib.sha256(b"https://a.b/c|some title").hexdigest()
    assert one(spark, T.content_hash(F.lit(" https://a.b/c "), F.lit(" Some TITLE"))) == wanted
    assert one(spark, T.content_hash(F.lit("u"), F.lit("t"), F.lit("given"))) == "given"
    assert one(spark, T.content_hash(F.lit("u"), F.lit("t"), F.lit(""))) == hashlib.sha256(b"u|t").hexdigest()


def test_titles_and_dates(spark):
    assert one(spark, T.strip_source_suffix(F.lit("A - B - Daily"), F.lit("Daily"))) == "A - B"
    assert one(spark, T.strip_source_suffix(F.lit("A - B"), F.lit("Daily"))) == "A - B"
    assert str(one(spark, T.mail_date(F.lit("Mon, 03 Jun 2024 10:20:30 +0300")))) == "2024-06-03 10:20:30"
    assert one(spark, T.mail_date(F.lit("junk"))) is None
    assert str(one(spark, T.day(F.lit("20240229")))) == "2024-02-29" and one(spark, T.day(F.lit("20240230"))) is None and one(spark, T.day(F.lit(""))) is None
    assert str(one(spark, T.compact_stamp(F.lit("20240603T102030z")))) == "2024-06-03 10:20:30"
    assert one(spark, T.safe_int(F.lit(" 7 "))) == 7 and one(spark, T.safe_double(F.lit("x"))) is None


def test_acronyms(spark):
    text = "Η ΑΔΕΔΥ και το Κ.Κ.Ε. με ΟΛΜΕ"
    masked = one(spark, T.mask_acronyms(F.lit(text)))
    assert masked.text == "Η ⟦0⟧ και το ⟦1⟧ με ⟦2⟧" and masked.acronyms == ["ΑΔΕΔΥ", "Κ.Κ.Ε.", "ΟΛΜΕ"]
    both = spark.range(1).select(T.mask_acronyms(F.lit(text)).alias("m")).select(T.restore_acronyms(F.col("m.text"), F.col("m.acronyms")).alias("x"))
    assert both.first().x == text


def test_labels(spark):
    cats = ["Mass Mobilization", "Labor & Economic"]
    for said, wanted in (("mass mobilization", cats[0]), ("1. labor stuff", cats[1]), ("other", "other")):
        assert one(spark, T.canonical_category(F.lit(said), cats)) == wanted
    assert [one(spark, T.confidence_bucket(F.lit(x))) for x in (0.56, 0.55, 0.41, 0.40)] == ["high", "medium", "medium", "low"]
    assert one(spark, T.synthetic_title(F.lit("Riot"), F.lit("Volos"), F.lit(" "))) == "Riot in Volos"
    assert one(spark, T.encode_keyword(F.lit("στάση εργασίας"))).startswith("%22%CF%83") and "%20" in one(spark, T.encode_keyword(F.lit("a b")))
    assert one(spark, T.is_greek(F.lit("καλημέρα hello"))) is True and one(spark, T.is_greek(F.lit("123"))) is False
    assert one(spark, T.fixed2(F.lit(None).cast("double"))) == "—" and T.search_query(["a", "b c"], "from:x") == '(a OR "b c") from:x'


def test_html(spark):
    page = "<html><nav>menu</nav><article><h1>Title</h1><script>x<y</script><p>" + "body &amp; soul " * 5 + "</p></article></html>"
    assert one(spark, T.html_text(F.lit(page))).startswith("Title body & soul") and one(spark, T.html_text(F.lit("<p>short</p>"))) is None


def test_fenced_objects(spark):
    for said, wanted in (
        ('```json\n{"locations": ["Athens", "Patras"]}\n```', ["Athens", "Patras"]), ('{"locations": "Athens"}', ["Athens"]), ('{"location": ["Volos"]}', ["Volos"]),
        ('{"location": "Volos"}', ["Volos"]), ('{"other": 1}', []), ('["a", "b"]', ["a", "b"]), ('"one"', ["one"]),
    ):
        assert one(spark, T.fenced_json(F.lit(said))) == wanted

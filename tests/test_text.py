from pyspark.sql import functions as F

from evidloom.bounds import local_table
from evidloom.functions import lexicon as lx
from evidloom.functions import scalars as sc
from evidloom.functions import text as tx


def one(spark, value, expr):
    return local_table(spark, [(value,)], "s string").select(expr(F.col("s")).alias("r")).first()[0]


def test_white_space_includes_unicode_spaces(spark):
    assert one(spark, " a \t b\n", tx.normalize_whitespace) == "a b"


def test_html_entities_are_decoded_once(spark):
    html = "<script>x</script><p>a &amp;lt; b</p><!-- c --><nav>d</nav>"
    assert one(spark, html, tx.html_to_text) == "a &lt; b"


def test_main_text_prefers_article_without_tables(spark):
    html = "<div>x</div><article>keep<table><tr>no</tr></table></article>"
    assert one(spark, html, tx.page_main_text) == "keep"
    assert one(spark, "<article> </article>rest", tx.page_main_text) == "rest"


def test_whole_words_respect_unicode_and_punctuation(spark):
    hits = one(spark, "que, élan (c++) naïve", lambda c: lx.word_terms(c, ["que", "lan", "c++", "na", "naïve"]))
    assert hits == ["que", "naïve"]


def test_sentence_length_is_strict(spark):
    from evidloom.operators.corpus import sentences
    docs = local_table(spark, [(1, "a" * 20 + ". " + "b" * 20 + "!  short? " + "c" * 30)], "doc_id long, text string")
    assert [r.sentence[0] for r in sentences(docs, ["doc_id"]).orderBy("sent_ord").collect()] == ["a", "b", "c"]
    docs = local_table(spark, [(1, "a" * 19 + ".")], "doc_id long, text string")
    assert sentences(docs, ["doc_id"]).count() == 0


def test_hint_class_tie_and_default(spark):
    hints = [("a", ["x", "y"]), ("b", ["z", "w"])]
    assert one(spark, "xzz", lambda c: lx.hint_class(c, hints, "none")) == "a"
    assert one(spark, "zwx", lambda c: lx.hint_class(c, hints, "none")) == "b"
    assert one(spark, "q", lambda c: lx.hint_class(c, hints, "none")) == "none"


def test_constraint_flags(spark):
    flags = one(spark, "avoid in pregnancy; not for small children", lx.constraint_flags)
    assert flags.asDict() == {"child_safe": False, "elderly_safe": True, "pregnant_safe": False}


def test_severity(spark):
    assert one(spark, "mild then severe", lx.severity_by_priority) == "high"
    last = lambda c: lx.severity_by_last_cue(tx.tokens(c))
    assert one(spark, "Severe, now mild.", last) == "low"
    assert one(spark, "nothing", last) == "medium"


def test_titles_prices_numbers(spark):
    assert one(spark, "mutra-krichra x2y", tx.title_case) == "Mutra-Krichra X2Y"
    assert one(spark, "a_bC", lambda c: sc.display_name(c, "first")) == "A bC"
    assert [one(spark, p, sc.price_parse) for p in ("₹199.50", "free", None)] == [19950, 0, 0]
    assert [one(spark, p, sc.lenient_int) for p in (" 12abc", "-3.9", "x")] == [12, -3, 0]
    assert [one(spark, p, sc.lenient_float) for p in ("1.5e2kg", ".5", "x")] == [150.0, 0.5, 0.0]


def test_json_salvage(spark):
    def salvage(c):
        return sc.json_salvage(c, "dosha string, n int", F.struct(F.lit("d").alias("dosha"), F.lit(0).alias("n")))

    assert one(spark, 'ok: {"dosha": "v", "n": 2} bye', salvage).asDict() == {"dosha": "v", "n": 2}
    assert one(spark, "{broken", salvage).dosha == "d"
    assert one(spark, "{ not json }", salvage).dosha == "d"
    assert one(spark, None, salvage).dosha == "d"


def test_lists(spark):
    assert one(spark, '[" A", "", "b"]', sc.normalize_list) == ["a", "b"]
    assert one(spark, " All ", sc.normalize_list) == ["all"]
    assert one(spark, None, sc.normalize_list) == []
    assert one(spark, "", lambda c: sc.join_or(c, "none", is_array=False)) == "none"


def test_dosage_is_not_scaled_twice(spark):
    def adjust(c):
        return sc.dosage_adjust(c, F.lit("Children"), F.lit("HIGH"))

    assert one(spark, "1 tablet", adjust) == (
        "INTENSIVE: Pediatric/Geriatric Scale (Half Dose): 1 tablet (Requires Physician Monitoring)")
    assert one(spark, "INTENSIVE Half Dose", adjust) == "INTENSIVE Half Dose"


def test_remedy_name(spark):
    terms = F.array(*[F.lit(x) for x in ("guduchi", "6 nights", "ab", "9 times", "neem leaf", "many days")])
    assert one(spark, "X Protocol", lambda c: sc.remedy_name(c, terms)) == "Guduchi, Neem Leaf"
    assert one(spark, "Vati", lambda c: sc.remedy_name(c, terms)) == "Vati (Guduchi, Neem Leaf)"
    assert one(spark, "Vati", lambda c: sc.remedy_name(c, F.array(F.lit("ab")))) == "Vati"

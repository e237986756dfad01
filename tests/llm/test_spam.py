import random

from pointspark.llm import spam

PROSE = ["I tried to replace the {a} but the {b} still leaks.", "Before you turn the {a}, write down where the {b} was.", "Has anyone measured the {a} without moving the {b}?", "My {a} stops after ten minutes, which makes me think of the {b}."]
THINGS = "valve hinge radiator sensor cable gasket filter pump bracket lens mirror axle".split()
WARES = ["bread pan", "yoga mat", "led strip", "rail kit"]
SHOP = "cheap buy price wholesale discount coupon sale".split()


def _pages():
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice(PROSE).format(a=r.choice(THINGS), b=r.choice(THINGS)) for _ in range(n))
    phrase = lambda w: f"{r.choice(SHOP)} {w}"
    link = lambda: f"https://{r.choice('abc')}{r.randrange(999)}.example/p?id={r.randrange(99)}"
    good = [prose(r.randrange(2, 9)) for _ in range(300)] + [f"see {link()}", prose(4) + " " + link(), "```\n" + "\n".join(f"{i};{i * 7};{i * 3}" for i in range(40)) + "\n```", "Qk9" * 400, prose(12) + "\n" + " ".join(phrase("yoga mat") for _ in range(6))]
    bad = [" ".join(phrase(w) for _ in range(20)) for w in WARES * 4] + ["\n".join(link() for _ in range(8)) for _ in range(8)] + ["".join(f"#{r.choice(WARES).title().replace(' ', '')}{r.choice(SHOP).title()}" for _ in range(12)) for _ in range(8)]
    bad += [prose(1) + "\n" + ", ".join(phrase(r.choice(WARES)) for _ in range(30)), "C​HEAP BREAD P​AN " * 9, "[best yoga mat](http://x.example)\n" * 6]
    return good, bad


def test_stuffed_pages_are_told_from_prose_code_and_data(spark):
    good, bad = _pages()
    rows = [(i, t, "en", "x") for i, t in enumerate(good + bad)] + [(9000, None, None, "x"), (9001, "", "en", "x"), (9002, " \n ", None, "x"), (0, good[0], "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, share string")
    assert {r["doc_id"] for r in spam.stuffed_pages(df).collect()} == set(range(len(good), len(good) + len(bad)))


def test_pages_whose_terms_are_too_rare_for_weights(spark):
    good, bad = _pages()
    code = "\n".join("qzv_buf[i] = qzv_fn(qzv_buf[j]);" for _ in range(30))
    own = ["zorbix " * 40, "plenkar morvat, " * 25]  # keywords of a single page
    tags = ["".join(f"#Vrost{chr(97 + i)}{chr(97 + j)}x" for i in range(8)) for j in range(2)]  # as many terms as tags, each on one page
    spelt = [" ".join(f"{w} drаin clеаnеr" for w in ("оnlinе", "bеst", "оriginаl", "sаlе", "оffiсiаl") * 3), " ".join("dеаl sоlаr lаmр nеаr mе" for _ in range(9))]
    plain = ["#include <a.h>\n#include <b.h>\n#define QQ\n#ifdef QQ\n#endif", "#main{color:red}#foot{margin:none;border:solid}#head{padding:none}", code]
    texts = good + plain + bad + own + tags + spelt
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in spam.stuffed_pages(df).collect()} == set(range(len(good) + len(plain), len(texts)))


def test_words_that_mix_scripts_are_folded(spark):
    df = spark.createDataFrame([(1, "drаin clеаnеr drain сыр", "en")], "doc_id long, text string, lang string")
    assert spam.Tokenizer().terms("drаin clеаnеr drain сыр") == ["drain", "cleaner", "drain", "сыр"]
    r = spam.segments(df, "doc_id", "text").first()
    assert dict(zip(r["terms"], r["counts"])) == {"drain": 2, "cleaner": 1, "сыр": 1}


def test_curve_of_known_frequencies(spark):
    df = spark.createDataFrame([(1, "a a a a b b c d", "en")], "doc_id long, text string, lang string")
    r = spam.curves(spam.segments(df, "doc_id", "text")).first()
    assert (r["terms"], r["vocabulary"], r["head"]) == (8, 4, 0.75) and -1.1 < r["slope"] < -0.9


def test_empty_and_prose_only(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert spam.stuffed_pages(df).count() == 0
    one = spark.createDataFrame([(1, "Just one short answer.", None)], "doc_id long, text string, lang string")
    assert spam.stuffed_pages(one).count() == 0


def test_language_is_recognised_from_the_text(spark):
    texts = {"en": "The pump is in the shed and it is full of water", "de": "Die Pumpe ist nicht mit dem Kabel und der Dichtung da", "ru": "В версии 3 такого не было", "zh": "我这边是旁边那根线的问题。", "ja": "一度冷ましてから、もう一度試してください", "ar": "هل هذا في العمود"}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r["doc"]: r for r in spam.segments(df, "doc_id", "text").collect()}
    assert {k: r["lang"] for k, r in got.items()} == {k: k for k in texts} and all(r["evidence"] >= 1 for r in got.values())


def test_only_pages_off_the_curve_of_prose_are_found(spark):
    good, bad = _pages()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    fits = spam.curves(spam.segments(df, "doc_id", "text"))
    odd = {r["doc"] for r in spam.candidate_pages(fits).collect()}
    assert {r["doc_id"] for r in spam.stuffed_pages(df).collect()} <= odd and len(odd & set(range(300))) < 30

import hashlib
import random
import re

from tempera.llm import disclosure as di

# The patterns as the contract states them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DOCS = "doc_id long, text string, email string, terms string, near string"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def sound(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return {k: [(m.start(), m.end(), m[0]) for m in re.finditer(p, text or "") if sound(k, m[0])] for k, p in PLAIN.items()}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "c", "c", "c") for i, t in docs], DOCS)


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(6)
    bits = ["a", "b.c", "@", ".", "-", "+", "%", "é", "🙂", " ", "\n", "1", "23", "255", "256", "4111111111111111", "(", ")", "x@y.z", "_", "+1 (555) 010-9999", "1.2.3.4"]
    docs = [(i, "".join(rng.choices(bits, k=rng.randrange(1, 25)))) for i in range(1500)]
    docs += [(2000, None), (2001, ""), (2002, "a" * 100_000 + "@"), (2003, "1" * 100_000), (2004, "a@" + "b." * 20_000 + "c"), (2005, "5.5.5.5 " * 3000)]
    docs += [(2006, "x@y.z"), (2006, "x@y.z"), (None, "x@y.z 4111 1111 1111 1111"), (2007, "+" + "1" * 50_000)]
    rows = di.personal_data(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    got = sorted((repr(r.doc_id), [[tuple(s) for s in r[k]] for k in di.KINDS]) for r in rows)
    assert got == sorted((repr(i), list(base(t).values())) for i, t in docs)


def corpus():
    rng = random.Random(2)
    words = [f"wort{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    plain = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, plain(30)) for i in range(60)]
    docs += [(100 + i, f"{plain(4)} Zebulon wrote to zeb@mail.example.org about {plain(6)}") for i in range(5)]
    docs += [(200, f"call 198.51.100.7 {plain(3)}"), (300, "Zebulon alone is not near anything")]
    return docs


def test_terms_that_reveal_an_entity(spark):
    docs = corpus()
    rows = {r.doc_id: r for r in di.personal_data(frame(spark, docs)).collect()}
    for i in range(5):
        text = dict(docs)[100 + i]
        terms = {t.term: (text[t.start : t.end], t.removed) for t in rows[100 + i].terms}
        assert terms["zebulon"][0] == "Zebulon" and {"wrote", "about"} <= set(terms)
        # It also stands in document 300: ln(67 * 5 / (5 * 6)) / ln(67 / 5) = 0.93, below removal.
        assert terms["zebulon"][1] is False and terms["wrote"][1] is True
    assert not rows[300].terms and not rows[200].terms and not rows[3].terms


def test_disclosure_matches_brute_force(spark):
    import math

    docs = corpus()
    df = frame(spark, docs)
    got = {(r.entity, r.term): r.disclosure for r in di.revealing_terms(df, di.found_values(df)).collect()}
    sets = [set(re.split(r"[^a-zA-Z]+", t.lower())) for _, t in docs]
    n, e = len(docs), 5
    for (entity, term), value in got.items():
        both = sum(term in s and "zeb@mail" in t for s, (_, t) in zip(sets, docs))
        df_t = sum(term in s for s in sets)
        assert entity == "email:zeb@mail.example.org"
        assert abs(value - math.log(n * both / (e * df_t)) / math.log(n / e)) < 1e-9
    assert ("email:zeb@mail.example.org", "zebulon") in got


def test_sanitised_text(spark):
    docs = corpus() + [(400, "🙂 x@y.z, 4111 1111 1111 1111 and +1 (555) 010-9999"), (401, "nothing here"), (402, None), (403, "+4222222222222, 1.1.1.1")]
    df = frame(spark, docs).select("doc_id", "text")
    found = di.personal_data(df).withColumnRenamed("doc_id", "f")
    got = {r.doc_id: r.clean for r in df.join(found, df.doc_id == found.f).select("doc_id", di.sanitised_text(df.text).alias("clean")).collect()}
    assert got[400] == "🙂 [EMAIL], [CARD] and [PHONE]" and got[401] == "nothing here"
    # Card and phone overlap at the start; the earlier span takes both in.
    assert got[403] == "[PHONE], [IP]"
    assert "[EMAIL]" in got[100] and "Zebulon" not in got[100] and "z*" in got[100] and "[REMOVED]" in got[100]


def test_query_columns(spark):
    rows = di.op6_disclosure(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        b = base(texts[r.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for k in di.KINDS for s, e, _ in b[k])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(b[k]) for k in di.KINDS]
        assert hashlib.sha256(listed.encode()).hexdigest() == r.base_sha256 and r.spans.startswith(listed)


def test_empty_table(spark):
    assert di.personal_data(frame(spark, [])).count() == 0


def test_terms_of_a_value_in_one_text(spark):
    # The value stands once in the corpus; what gives it away stands paragraphs off, twice, or has two letters.
    far = "wortq " * 40 + "\n\n"
    docs = [(i, "wortq wortr worts") for i in range(400)]
    docs += [(500, f"Yo Vandermeer signed.\n\n{far}mail yo.v@mail.example.org now\n\n{far}Later VANDERMEER left, and Yo too.")]
    docs += [(501, "Vandermeer has no address here")]
    row = next(r for r in di.personal_data(frame(spark, docs)).collect() if r.doc_id == 500)
    text = dict(docs)[500]
    got = [(text[t.start : t.end], t.removed) for t in row.terms]
    # ln(402 / (2 + 2)) / ln(402) = 0.77 is below generalising for a name that another document has, ln(402 / 3) / ln(402) = 0.82 is not.
    assert [w for w, _ in got] == ["Yo", "signed", "mail", "now", "Later", "left", "and", "Yo", "too"]
    assert not any(removed for _, removed in got)
    more = docs + [(600 + i, f"text {i} of another day") for i in range(3000)]
    row = next(r for r in di.personal_data(frame(spark, more)).collect() if r.doc_id == 500)
    assert [text[t.start : t.end] for t in row.terms if t.term == "vandermeer"] == ["Vandermeer", "VANDERMEER"]


def test_copies_are_one_text_and_pairs_are_counted_over_whole_documents(spark):
    import math

    far = " filler" * 60
    docs = [(i, "filler only") for i in range(300)]
    docs += [(400 + i, f"Quill{far} reach q@mail.example.org") for i in range(4)]
    docs += [(500 + i, f"{i} Brandt{far} reach b@mail.example.org{far} here") for i in range(4)] + [(510, "Brandt")]
    df = frame(spark, docs)
    got = {(r.entity, r.term): r.disclosure for r in di.revealing_terms(df, di.found_values(df), generalise=-9.0).collect()}
    n = len(docs)
    assert abs(got["email:q@mail.example.org", "quill"] - math.log(n * 4 / (4 * (4 + 8))) / math.log(n / 4)) < 1e-9
    assert abs(got["email:b@mail.example.org", "brandt"] - math.log(n * 4 / (4 * 5)) / math.log(n / 4)) < 1e-9


def test_word_places(spark):
    rng = random.Random(9)
    texts = ["", "é🙂b", " a ", "x" * 500] + ["".join(rng.choices(["wort", "É", " ", "🙂", ".", "1", "\n"], k=rng.randrange(900))) for _ in range(40)]
    got = di._word_places(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "text_id string, text string")).collect()
    want = [(str(i), m[0].lower(), m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer(r"[^\W\d_]+", t)]
    assert sorted((r.text_id, r.term, r.start, r.end) for r in got) == sorted(want)

import random
import re

from tempera.llm import line_cleaning as lc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "Here the people of the old town met and spoke of the weather that came over the hills every spring."


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
    )


def failed(line):
    words, bare = WORD.findall(line), line.strip(" \t\n\x0b\x0c\r")
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in bare)
    parting = sum(w in lc.PARTING for w in words)
    return (
        (parting >= 2 and 8 * parting >= len(words)) or low in lc.MENU_LINES or any(p in low for p in lc.STOCK_PHRASES)
        or 2 * sum(c in lc.MARKS for c in line) > len(words) or (len(words) < lc.LONG_LINE and not re.search(lc.SENTENCE_END, bare))
    )


def verdict(text):
    n, chars, _, _, repeated = counts(text)
    once = list(dict.fromkeys(x for x in (text or "").split("\n") if WORD.search(x)))
    clean = "\n".join(x for x in once if not failed(x))
    left = WORD.findall(clean)
    base_failed = n < 50 or 100 * repeated > 50 * n
    kept = not base_failed and 100 * (chars - sum(map(len, left))) <= 50 * chars and len(left) >= 50
    return base_failed, clean, kept


def rows(spark, texts):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in texts], "doc_id long, text string, n_words long, kept string")
    return lc.cleaned(df).collect()


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "of", "été", "🙂", "x1", "###", "no!!", "|", ">", "end.", "stop?", "K\x0bq", "\x85", " z", "İ"]
    ends = ["\n", "\n\n", " \n", "\r\n", "\t", " "]
    texts = [(i, "".join(rng.choice(vocabulary) + rng.choice([" "] * 9 + ends) for _ in range(rng.randrange(0, 220)))) for i in range(150)]
    texts += [(900, None), (901, ""), (902, " \n \t\n"), (903, "one two"), (904, "one two three"), (905, "a a a a a"), (None, PROSE), (3, PROSE)]
    got = {(r.doc_id, r.clean_text): r for r in rows(spark, texts)}
    for i, t in texts:
        base_failed, clean, kept = verdict(t)
        r = got[i, clean]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t), (i, t)
        assert (r.base_failed, r.kept, r.clean_words) == (base_failed, kept, counts(clean)[0])
        assert r.lost_chars == counts(t)[1] - counts(clean)[1]


def test_rules_act_line_by_line(spark):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(18)) + "." for i in range(6))
    page = f"Home | About | Contact\nlogin\n{prose}\nThis site uses cookies, see below.\nWhat ### is ### this ###.\nno end here\n{PROSE}\n{PROSE}"
    (r,) = rows(spark, [(1, page)])
    assert r.clean_text == f"{prose}\n{PROSE}" and r.kept
    assert r.lost_lines == {"navigation": 2, "boilerplate": 1, "punctuation": 2, "repeated": 1}
    menus = "\n".join(f"Section {i} | Page {i} | Part {i}" for i in range(40))
    by_id = {r.doc_id: r for r in rows(spark, [(1, prose), (2, f"{menus}\n{prose}"), (3, menus)])}
    assert by_id[1].kept and by_id[1].clean_text == prose and by_id[1].lost_chars == 0
    assert not by_id[2].base_failed and not by_id[2].kept and not by_id[3].kept and by_id[3].clean_text == ""


def test_nulls_repeats_long_and_empty(spark):
    long = " ".join(f"w{i % 40_000}" for i in range(60_000))
    got = rows(spark, [(None, None), (1, "same text."), (1, "same text."), (2, long)])
    assert len(got) == 4
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].n_words == 0 and by_id[None].base_failed and not by_id[None].kept and by_id[None].clean_text == ""
    assert by_id[2].n_words == 60_000 and by_id[2].n_repeat_words == 40_000 and by_id[2].base_failed
    assert rows(spark, []) == []

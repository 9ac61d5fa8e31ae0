import re

from packlens.llm import decontaminate as D

from .conftest import make

QUESTION = "A farmer named Anna has 12 apples and buys 30 more apples for 5 dollars, then gives 12 apples to her friend Bert before going home at night."


def brute(text, item, width=8, literals=3, enough=6, share=0.5):
    """The same decision by comparing all windows."""

    up, letter = lambda c: c.isupper() and c.isalpha(), str.isalpha

    def plain(t):
        return re.sub(r"[.,:]+(?!\d)", "", re.sub(r"[^\w\s.,:]+|_", "", t or ""))

    def tokens(t):
        """(template, value) of each word, names of several words being one."""
        out, run = [], []
        for w in plain(t).split():
            caps = up(w[0]) and all(map(letter, w))
            if run and up(w[0]):
                run.append(w)
            elif run:
                out.append(" ".join(run))
                run = []
            if not run:
                (run if caps else out).append(w)
            elif not caps and run[-1] == w:  # a word like R2 ends a run
                out.append(" ".join(run))
                run = []
        out += [" ".join(run)] * bool(run)
        pairs = []
        for w in out:
            if up(w[0]) and all(letter(c) or c == " " for c in w):
                pairs.append(("~", w.lower()))
            elif re.fullmatch(r"\d+(?:[.,:]+\d+)*", w):
                pairs.append(("#", w))
            elif pairs and pairs[-1][0] == "#" and re.fullmatch(rf"(?i)(?:{D.UNITS})", w):
                pairs.append(("^", w.lower()))
            else:
                pairs.append((re.sub(r"\d+(?:[.,:]+\d+)*", "#", w).lower(), w.lower()))
        return pairs

    def aligned(it, dt, least):
        w = min(width, len(it))
        wins = {p: it[p : p + w] for p in range(len(it) - w + 1) if w and sum(x not in ("~", "#", "^") for x in it[p : p + w]) >= least}
        need, by = max(1, min(enough, -(-len(wins) * share // 1))), {}
        for d in range(len(dt) - w + 1):
            for p, win in wins.items():
                if dt[d : d + w] == win:
                    by.setdefault(d - p, set()).add(p)
        return [(delta, sum(not {"~", "#", "^"} & set(wins[p]) for p in ps) >= need) for delta, ps in by.items() if len(ps) >= need]

    if aligned(plain(item).lower().split(), plain(text).lower().split(), -99):
        return True
    a, b = tokens(item), tokens(text)
    for delta, free in aligned([x for x, _ in a], [x for x, _ in b], literals):
        pairs = {(v, b[i + delta][1]) for i, (x, v) in enumerate(a) if x in ("~", "#", "^") and 0 <= i + delta < len(b) and b[i + delta][0] == x}
        if free or len(pairs) == len({v for v, _ in pairs}):
            return True
    return False


def leaks(docs, bench):
    return {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()}


def test_reparameterised_question(spark):
    bench = spark.createDataFrame([(1, QUESTION), (2, None), (None, QUESTION), (3, "too short"), (4, "one two three four")], "item_id long, text string")
    again = QUESTION.replace("12", "40").replace("30", "7.5").replace("Anna", "Maria").replace("5 dollars", "9 euros")
    mixed = QUESTION.replace("12", "40", 1).replace("30", "7").replace("Bert", "Carl")  # one 12 became 40, the other stayed
    rows = D.find_leaks(make(spark, ["before it " + QUESTION + " and after", again, mixed, "nothing here", None, "", "x one two three four y", QUESTION[:70]]), bench).collect()
    by = {(r.doc_id, r.item_id): r for r in rows}
    assert (0, 1) in by and by[0, 1].exact and by[0, 1].consistent
    assert (1, 1) in by and not by[1, 1].exact and by[1, 1].consistent
    assert (2, 1) not in by and (6, 4) in by
    assert not {d for d, _ in by} & {3, 4, 5}


TOM = "Tom has 5 marbles. Tom buys 3 more marbles. How many marbles does Tom have now? Tom shares 2 marbles with Ann Lee at 12:30."


def test_names_anywhere_and_of_any_length(spark):
    bench = spark.createDataFrame([(1, TOM), (2, "12 7 3.14 9 8 5 5 1 2 30 4 18 6"), (3, "Anna Maria Bert Carl " * 4)], "item_id long, text string")
    other = TOM.replace("Tom", "Mary Ann").replace("5", "7").replace("3 ", "4 ").replace("Ann Lee", "Bob")
    texts = [other, TOM.upper(), TOM.lower() + " and so on", TOM.replace("12:30", "12:45"), "a 12 7 3.14 9 8 5 5 1 2 30 4 18 6 b", "a 12 7 314 9 8 5 5 1 2 30 4 18 6 b".replace("5 5 1", "5 6 1"),
             "see Anna Maria Bert Carl Anna Maria Bert Carl Anna Maria Bert Carl Anna Maria Bert Carl", other.replace("Mary Ann shares", "Joe shares")]
    rows = {(r.doc_id, r.item_id): r for r in D.find_leaks(make(spark, texts), bench).collect()}
    assert set(rows) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (6, 3)}
    assert not rows[0, 1].exact and rows[1, 1].exact and rows[1, 1].coverage == 1 and rows[4, 2].exact
    assert {(d, i) for d, t in enumerate(texts) for i, q in ((1, TOM), (2, "12 7 3.14 9 8 5 5 1 2 30 4 18 6"), (3, "Anna Maria Bert Carl " * 4)) if brute(t, q)} == set(rows)


def test_columns_are_of_one_alignment(spark):
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    part = " ".join(QUESTION.split()[:15])
    r = D.find_leaks(make(spark, [part + " x " + QUESTION.replace("30", "77")]), bench).collect()[0]
    assert r.coverage == r.n_windows / r.n_total and not r.exact


def test_against_brute_force(spark, docs, bench):
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {(d, i) for d, t in rows for i, q in items if brute(t, q)}
    assert want and leaks(docs, bench) == want
    whole = {(d, i) for d, t in rows for i, q in items if q in t}
    assert whole <= want


def test_short_items_leak_only_as_whole_texts(spark):
    bench = spark.createDataFrame([(1, "the"), (2, "Forty two!"), (3, "The sky is"), (4, "One two three four"), (5, "?!"), (6, "forty TWO")], "item_id long, text string")
    texts = ["the", "the cat saw the dog", "forty, two", "forty two three", "the sky is blue", "the sky is", "see one two three four there", "", None, "...", "THE"]
    assert leaks(make(spark, texts), bench) == {(0, 1), (10, 1), (2, 2), (2, 6), (5, 3), (6, 4)}
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_total, r.coverage, r.exact) for r in D.find_leaks(make(spark, texts), bench, least=1).collect()}
    assert (1, 1) in got and (3, 2) in got and (5, 3) in got


def test_odd_and_empty(odd_docs, no_docs, bench):
    assert leaks(odd_docs, bench) == set() and leaks(no_docs, bench) == set() and leaks(odd_docs, bench.limit(0)) == set()
    assert leaks(odd_docs.withColumnRenamed("n", "kind").withColumnRenamed("key", "h"), bench) == set()
    assert D.drop_leaks(odd_docs, bench).count() == odd_docs.count()

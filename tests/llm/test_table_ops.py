"""Operators that join or learn over whole tables, against brute force, SQL or held-out rows."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import data
import duckdb
import numpy as np
import pytest

from proofgrid.llm import chat_quotes, near_dups, packing, quality_rules, queries, toxicity, url_filters


def link_classes(texts: dict[int, str | None]) -> dict[int, int]:
    """Classes by comparing all pairs of texts."""
    grams = {}
    for k, text in texts.items():
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for sign in "\t\n\x0b\x0c\r":
            lowered = lowered.replace(sign, " ")
        words = [w for w in lowered.split(" ") if w]
        n = min(5, len(words))
        grams[k] = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(k for k in texts if grams[k])
    sets, repeats = {k: frozenset(grams[k]) for k in ids}, {k for k in ids if max(grams[k].values()) > 1}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            ga, gb = grams[a], grams[b]
            if sets[a].isdisjoint(sets[b]) or find(a) == find(b):
                continue
            common, every = sets[a] & sets[b], sets[a] | sets[b]
            near = len(common) / len(every) >= 0.8
            if not near and (a in repeats or b in repeats):
                near = sum(1 / sum(max(ga[z] / ga[x], gb[z] / gb[x]) for z in every) for x in common) >= 0.8
            if near:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in texts}


def classes(df) -> dict[int, int]:
    return {r.doc_id: r.class_id for r in df.collect()}


def test_near_duplicates_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = link_classes({r.doc_id: r.text for r in docs.collect()})
    assert len(set(want.values())) < len(want)
    assert classes(near_dups.near_duplicates(docs)) == want


def test_near_duplicate_recall_at_a_larger_size(spark, small):
    """Classes of sf0.01 against all pairs that share a shingle, found by an inverted index; no class may be split."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    grams, posting, texts = {}, defaultdict(list), {r.doc_id: r.text for r in docs.collect()}
    for k, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        n = min(5, len(words))
        grams[k] = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()
        for g in grams[k]:
            posting[g].append(k)
    common = Counter((a, b) for ids in posting.values() for i, a in enumerate(ids) for b in ids[i + 1 :])
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for (a, b), n in common.items():
        ga, gb = grams[a], grams[b]
        near = n >= 0.8 * (len(ga) + len(gb) - n)
        if not near and n >= 0.4 * min(len(ga), len(gb)) and (max(ga.values()) > 1 or max(gb.values()) > 1):
            near = sum(1 / sum(max(ga[z] / ga[x], gb[z] / gb[x]) for z in ga.keys() | gb.keys()) for x in ga.keys() & gb.keys()) >= 0.8
        if near:
            linked += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = near_dups.near_duplicates(docs).collect()
    assert linked > 20 and {r.doc_id: r.class_id for r in found} == {k: find(k) for k in texts}
    assert all((r.links > 0) == (r.class_size > 1) for r in found)


def test_template_pages_do_not_meet(spark, monkeypatch):
    """Pages that share seven tenths of their text: their wide buckets give way to rare shingles, which few share."""
    monkeypatch.setattr(near_dups, "WIDE", 10)
    template, r = data.prose(140, 1), random.Random(3)
    texts = {k: template + " " + " ".join(f"w{r.randrange(10**9)}" for _ in range(60)) for k in range(80)}
    texts |= {100 + k: texts[k].replace(texts[k].split()[-1], "changed") for k in range(10)}
    met = []
    kept = near_dups._rare_buckets
    monkeypatch.setattr(near_dups, "_rare_buckets", lambda *x: met.append(kept(*x)) or met[-1])
    discarded = near_dups.discard
    monkeypatch.setattr(near_dups, "discard", lambda *x: discarded(*[t for t in x if t not in met]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert classes(near_dups.near_duplicates(docs, bands=60, rows=2)) == {k: k % 100 for k in texts}
    assert len(met) == 1 and met[0].groupBy("bucket").count().where("count > 2").isEmpty()


@pytest.mark.parametrize("wide", [1024, 10])
def test_near_duplicates_in_large_buckets(spark, monkeypatch, wide):
    """Variants of one text: a crowd that shares most bands, dealt in blocks, with chains that only some pairs link."""
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    monkeypatch.setattr(near_dups, "WIDE", wide)
    monkeypatch.setattr(near_dups, "FIRST_BANDS", 1)
    r, base = random.Random(3), data.prose(90, 9).split()
    texts = {}
    for k in range(70):
        words = list(base)
        for _ in range(r.randint(1, 3)):
            words[r.randrange(len(words))] = f"neu{r.randrange(10_000)}"
        texts[k] = " ".join(words * r.choice([1, 1, 1, 2]))
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    assert classes(near_dups.near_duplicates(docs)) == link_classes(texts)


def test_near_duplicates_by_set_where_repeats_differ(spark):
    """One line stands twice in one text and eighty times in the other: one shingle set, little weight in common."""
    texts, r = {}, random.Random(11)
    for k in range(12):
        words = [f"w{k}x{r.randrange(10**9)}" for _ in range(230)]
        body, line = " ".join(words[:200]), " ".join(words[200:])
        texts[3 * k] = f"{body} {line} {line}"
        texts[3 * k + 1] = " ".join([body, *[line] * 80])
        texts[3 * k + 2] = f"{body} {line}"  # no repeats
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = link_classes(texts)
    assert want == {k: k - k % 3 for k in texts}
    assert classes(near_dups.near_duplicates(docs)) == want


def test_near_duplicates_on_awkward_rows(spark):
    rows = data.rows()
    found = near_dups.near_duplicates(data.table(spark)).collect()
    assert Counter(x.doc_id for x in found) == Counter(x[0] for x in rows)
    named = [x for x in found if x.doc_id is not None]
    assert {x.doc_id: x.class_id for x in named} == link_classes({x[0]: x[1] for x in rows if x[0] is not None})
    assert Counter(x.class_id for x in named if x.kept) == Counter({x.class_id for x in named})
    assert all(x.class_id is None and x.kept for x in found if x.doc_id is None)
    assert near_dups.near_duplicates(data.table(spark, [])).collect() == []
    kept = near_dups.keep_one(data.table(spark))
    assert kept.columns == data.table(spark).columns
    assert kept.where("doc_id is null").count() == 2 and kept.where("doc_id in (0, 1)").count() == 1
    assert near_dups.keep_one(data.table(spark, [])).collect() == []


def test_near_duplicates_tell_rows_apart(spark):
    """Rows without doc_id join the class of their text; two texts under one doc_id stay two; columns of any name."""
    one, two, three = (data.prose(80, 60 + k) for k in range(3))
    near = one.replace(one.split()[3], "changed")
    rows = [(5, one), (None, one), (None, near), (5, two), (8, two), (None, three), (None, three), (9, None), (None, ""), (5, one)]
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, _row int")
    found = near_dups.near_duplicates(docs)
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in found.collect())
    assert got == Counter({(5, 5, 4): 2, (None, 5, 4): 2, (5, 5, 2): 1, (8, 5, 2): 1, (None, None, 2): 2, (9, 9, 1): 1, (None, None, 1): 1})
    kept = near_dups.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(5, one), (5, two), (None, three), (9, None), (None, "")])


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "pick", lambda rows, ids, key: rows.join(ids.hint("shuffle_hash"), key, "left_semi"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert classes(near_dups.near_duplicates(docs)) == link_classes({r.doc_id: r.text for r in docs.collect()})


def test_recall_where_repeats_differ(spark):
    """Sets alike at 0.8 or more, one line repeated 20 times in one of the two: nine in ten or more are found."""
    r, pairs = random.Random(21), {}
    for k in range(100):
        words = [f"v{k}x{r.randrange(10**9)}" for _ in range(220)]
        other = list(words)
        other[r.randrange(30, 190)] = "new"
        pairs[2 * k], pairs[2 * k + 1] = " ".join(words), " ".join([*other, *words[-20:] * 20])
    docs = spark.createDataFrame(list(pairs.items()), "doc_id long, text string")
    want, got = link_classes(pairs), classes(near_dups.near_duplicates(docs))
    linked = [k for k, root in want.items() if k != root]
    assert len(linked) > 80 and sum(got[k] == want[k] for k in linked) >= 0.9 * len(linked)


def test_toxicity_on_held_out_rows(spark):
    from pyspark.sql import functions as F

    at = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op4_noisy_channel"](spark, at).where("held_out")
    assert scored.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).isEmpty()
    rows = scored.join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    good, bad = score[toxic == 0], score[toxic == 1]
    assert len(good) > 300 and len(bad) > 20
    area = ((bad[:, None] > good) + 0.5 * (bad[:, None] == good)).mean()
    assert area > 0.88  # some rows are labelled toxic though no bad word was seen in them; 0.906 was measured
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    assert ((score >= 0.5) == [r.predicted for r in rows]).all()


def test_disguised_words_are_restored(spark):
    words = "banana cabbage stupid message orange little".split()
    docs = spark.createDataFrame([(" ".join(random.Random(k).choices(words, k=60)),) for k in range(50)], "text string")
    model = toxicity.char_model(docs)
    assert np.allclose(np.exp(model).sum(2), 1)
    for shown, meant in [("b4n4n4", "banana"), ("stuuuupid", "stupid"), ("m3ss@ge", "message"), ("c.a.b.b.a.g.e", "cabbage"), ("or*nge", "orange"), ("l1ttl3", "little")]:
        assert toxicity.words_of(shown, model) == meant
    assert "stupid" in toxicity.restored_words("so s t u p i d really", model, {})


def test_viterbi_finds_the_best_of_all_readings(spark):
    docs = spark.createDataFrame([(data.prose(200, k),) for k in range(20)], "text string")
    model = toxicity.char_model(docs)
    r = random.Random(4)

    def every(word, i=0, score=0.0, text=""):
        if i == len(word):
            yield score, text
            return
        reads, skip = toxicity.readings(word, i)
        for x, cost in reads:
            yield from every(word, i + 1, score + cost, text + x)
        if skip is not None:
            yield from every(word, i + 1, score + skip, text)

    def log_p(text):
        s = [0, 0, *map(toxicity._symbol, text), 0]
        return sum(model[s[k], s[k + 1], s[k + 2]] for k in range(len(s) - 2))

    for _ in range(200):
        word = "".join(r.choice("abe.o-013$*!") for _ in range(r.randint(1, 6)))
        scores = {}
        for score, text in every(word):
            scores[text] = max(score + log_p(text), scores.get(text, -1e9))
        assert scores[toxicity.restore(word, model)] == pytest.approx(max(scores.values()))


def test_long_mixed_words_take_linear_time(spark):
    import time

    model = toxicity.char_model(spark.createDataFrame([(data.prose(500, 1),)], "text string"))
    half = 500_000
    r = random.Random(2)
    for word in ("a" * half + "/" + "b" * half, "".join(r.choice("abcdefgh") for _ in range(half)) + "/" + "ab" * (half // 2), "-" * half + "a" + "_" * half, "a/" + "!" * half + "?" * half, "ab4cd" * (half // 5), "a.b." * (half // 4)):
        began = time.perf_counter()
        toxicity.words_of(word, model)
        assert time.perf_counter() - began < 30  # quadratic work would take hours


def test_only_verified_near_copies_are_left_out(spark):
    """Texts that share half of their runs stay; exact copies and those with one word changed go."""
    import pyarrow as pa

    base = [data.prose(100, 50 + k) for k in range(6)]
    texts = {k: t for k, t in enumerate(base)}
    texts |= {10 + k: t for k, t in enumerate(base[:3])}  # exact copies
    texts |= {20 + k: t.replace(t.split()[-1], "changed") for k, t in enumerate(base[:3])}  # near copies
    texts |= {30 + k: base[0][: len(base[0]) // 2] + " " + data.prose(50, 90 + k) for k in range(3)}  # one half shared
    texts |= {40: "two words", 41: "two words", 42: ""}  # without runs
    ids = sorted(texts)
    runs = toxicity._runs(pa.array([texts[k] for k in ids]))
    rows = [(k, toxicity._minima(x), x.view(np.int64).tolist()) for k, x in zip(ids, runs, strict=True)]
    sample = spark.createDataFrame(rows, "doc_id long, sketch array<long>, runs array<long>")
    assert {r.doc_id for r in toxicity.copies(sample).collect()} == {10, 11, 12, 20, 21, 22}


def test_labels_other_than_one_and_zero_are_none(spark):
    docs = spark.createDataFrame([(k, data.prose(60, k) + (" badword" if k % 4 == 0 else "")) for k in range(160)], "doc_id long, text string")
    labels = [(k, int(k % 4 == 0)) for k in range(160)]
    other = [(k, (2, -1, None)[k % 3]) for k in range(160)]
    scored = [{r.doc_id: r.score for r in toxicity.score_texts(docs, toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int"))).collect()} for x in (labels, labels + other, other)]
    assert scored[0] == scored[1] and max(scored[0].values()) > 0.5
    assert len(set(scored[2].values())) == 1


def test_toxicity_on_awkward_rows(spark):
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    scorer = toxicity.fit(data.table(spark), labels)
    found = toxicity.score_texts(data.table(spark), scorer).collect()
    assert len(found) == len(data.rows()) and all(0 <= r.score <= 1 for r in found)
    assert {r.held_out for r in found if r.doc_id is None} == {False}
    assert toxicity.score_texts(data.table(spark, []), scorer).collect() == []
    nothing = toxicity.fit(data.table(spark, []), labels.limit(0))
    assert toxicity.drop_toxic(data.table(spark), nothing).count() == len(data.rows())


def test_host_reputation_equals_sql(spark, small):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = queries.QUERIES["op10_host_reputation"](spark, small)
    want = con.execute(queries.SQL["op10_host_reputation"])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    rows = lambda records: sorted(tuple(map(str, r)) for r in records)
    assert rows(found.select(names).collect()) == rows(want.fetchall())


def test_hosts_paths_and_rules(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/x": ("", "", None, "allow"), "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net": ("example.net", "", None, "allow"), "x://foo.net/": ("foo.net", "/", "net/", "block"), "http://www.example.com/de/": ("www.example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "http://a.org/fr/1://b": ("a.org", "/fr/1://b", "org/fr/", "allow"), "http://bad.co.uk:80/a\nb": ("bad.co.uk:80", "/a\nb", None, "block"),
        "a://ÄB.net?x": ("Äb.net", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(cases)] + [(100 + k, "http://bad.co.uk:80/", "x") for k in range(60)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + k, 1) for k in range(60)] + [(100, 1), (None, 0), (2, None)], "page_id long, bad int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages, labels).collect()}
    for k, (url, want) in enumerate(cases.items()):
        # "no scheme" and unlabelled hosts take the corpus rate, which the labels of this fixture make high
        assert found[k][:3] == want[:3], url
        if want[2]:
            assert found[k][3] == want[3]
    assert found[100][3] == "block"
    assert url_filters.filter_urls(pages.limit(0), labels).collect() == []
    assert {r.verdict for r in url_filters.filter_urls(pages, labels.limit(0)).where("rule is null").collect()} == {"allow"}


def test_reputation_shrinks_towards_parents(spark):
    rows = [("a.one.com", 0, 0), ("b.one.com", 200, 180), ("x.two.com", 1, 1), ("y.two.com", 400, 4), ("z.net", 50, 0)]
    outcomes = spark.createDataFrame(rows, "host string, n long, bad long")
    found = {r.host: r for r in url_filters.reputation(outcomes, url_filters.STRENGTH).collect()}
    assert found["a.one.com"].domain == "one.com" and found["a.one.com"].suffix == "com"
    assert found["a.one.com"].rate > 0.5 > found["x.two.com"].rate > found["y.two.com"].rate
    assert all(0 <= r.lower <= r.rate <= 1 for r in found.values())
    corpus = (185 + 0.5) / (651 + 1)
    suffix = (185 + 50 * corpus) / (601 + 50)
    domain = (180 + 20 * suffix) / (200 + 20)
    assert found["b.one.com"].rate == pytest.approx((180 + 10 * domain) / (200 + 10))


def test_strength_is_estimated_from_the_data(spark):
    """Hosts drawn around their domain with 4 and with 200 pseudo-observations: the estimate tells them apart."""
    r, found = np.random.default_rng(8), {}
    for k in (4.0, 200.0):
        rows = []
        for d in range(60):
            mean = 0.2 + 0.4 * (d % 2)
            for h in range(20):
                n = int(r.integers(5, 60))
                rows.append((f"h{h}.d{d}.com", n, int(r.binomial(n, r.beta(k * mean, k * (1 - mean))))))
        got = url_filters.reputation(spark.createDataFrame(rows, "host string, n long, bad long")).first()
        found[k] = got.alpha + got.beta - got.n
        assert k / 1.6 < found[k] < k * 1.6
    alone = url_filters.reputation(spark.createDataFrame([("a.com", 9, 3)], "host string, n long, bad long")).first()
    assert alone.alpha + alone.beta - alone.n == pytest.approx(url_filters.STRENGTH["host"])


def test_addresses_and_labels_without_outcome(spark, tmp_path):
    got = {r.host: (r.domain, r.suffix) for r in url_filters.reputation(spark.createDataFrame([("10.0.0.4", 1, 0), ("10.0.0.4:80", 1, 0), ("", 1, 0), ("localhost", 1, 0), ("a.co.uk", 1, 0)], "host string, n long, bad long")).collect()}
    assert got == {"10.0.0.4": ("10.0.0.4", ""), "10.0.0.4:80": ("10.0.0.4", ""), "": ("", ""), "localhost": ("", "localhost"), "a.co.uk": ("a.co.uk", "co.uk")}
    spark.createDataFrame([(k, f"http://h{k % 2}.com/") for k in range(40)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(k, 1 if k % 2 else None, None, "x") for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int, page_id string").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.QUERIES["op10_host_reputation"](spark, str(tmp_path)).collect()
    assert {r.verdict for r in rows if r.host == "h1.com"} == {"block"} and len(rows) == 40
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(queries.SQL["op10_host_reputation"])
    names = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in rows))) == sorted(map(str, want.fetchall()))


def test_quotes_are_linked_and_removed(spark):
    m = [
        (1, 0, "user", "How do I sort a table?\nIt is large."), (1, 1, "assistant", "> How do I sort a table?\n\nUse orderBy."),
        (1, 2, "user", "On Monday, x wrote:\n> > how do I  sort a table\n> Use orderBy.\nThanks!"), (1, 3, "user", "> It is large.\nHow large?"), (1, 4, "assistant", "> nobody said this\nok"),
        (2, 0, "user", None), (2, 1, "assistant", "> Use orderBy.\nother conversation"), (None, 5, "user", "> Thanks!\nlost"), (3, None, "user", "no turn"),
    ]
    table = spark.createDataFrame(m, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): r for r in chat_quotes.format_chats(table).collect()}
    assert len(found) == len(m)
    links = {k: (r.parent_turn, r.root_turn, r.depth, r.n_quotes, r.n_linked, r.max_level) for k, r in found.items()}
    assert links[1, 1] == (0, 0, 1, 1, 1, 1)
    assert links[1, 2] == (1, 0, 2, 2, 2, 2)
    assert links[1, 3] == (0, 0, 1, 1, 1, 1)
    assert links[1, 4] == (None, 4, 0, 1, 0, 1)
    assert links[2, 1][:2] == (None, 1) and links[2, 0] == (None, 0, 0, 0, 0, 0)
    assert links[None, 5][:2] == (None, None)
    assert found[1, 2].body == "Thanks!" and found[1, 1].body == "Use orderBy." and found[2, 0].body == ""
    assert chat_quotes.format_chats(table.limit(0)).collect() == []


def test_partial_quotes_find_their_message(spark):
    four, three = "l1 is here\nl2 is here\nl3 is here\nl4 is here", "first par\nof two lines\n\nsecond par\n\nthird par"
    m = [
        (0, four), (1, three), (2, "> l2 is here\n> l3 is here\nwhy?"), (3, "> second par\n>\n> third par\nso?"),
        (4, "> l4 is here\nmine one\n> third par\nmine two\nmine three"), (5, "> mine two\n> mine three\nfine"),
        (6, "> l2 is here\n> nobody said this\nhm"), (7, "Yes."), (2000, "Yes."), (2001, "> Yes.\nsure"), (5000, "> Yes.\nlate"), (5001, "> yes\nYes."), (5002, "> Yes.\nagain"),
        (6000, "mine one"), (6001, "> mine one\n> mine two\n> mine three\nwhole elsewhere"),
    ]
    table = spark.createDataFrame([(1, turn, "user", text) for turn, text in m] + [(2, 9, "user", "> l2 is here\nother"), (1, 7, "user", "> Yes.\nthe same turn")], "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): (r.parent_turn, r.n_quotes, r.n_linked) for r in chat_quotes.format_chats(table).collect()}
    want = {2: (0, 1, 1), 3: (1, 1, 1), 4: (1, 2, 2), 5: (4, 1, 1), 6: (0, 1, 1), 7: (None, 1, 0), 2001: (2000, 1, 1), 5000: (2000, 1, 1), 5001: (2000, 1, 1), 5002: (5001, 1, 1), 6001: (4, 1, 1)}
    assert {turn: found[1, turn] for turn in want} == want
    assert found[2, 9] == (None, 1, 0)


def test_quotes_equal_brute_force(spark, monkeypatch):
    """Few sentences said and quoted again and again, in spans of few turns."""
    monkeypatch.setattr(chat_quotes, "SPAN", 4)
    r, said = random.Random(5), [f"sentence {k}" for k in range(7)]
    m = []
    for conv in range(3):
        for turn in sorted(r.sample(range(-10, 60), 40)):
            quoted = [f"> {r.choice(said)}" if r.random() < 0.8 else ">" for _ in range(r.randint(0, 4))]
            m.append((conv, turn, "user", "\n".join(quoted + [r.choice(["", *said]) for _ in range(r.randint(1, 4))])))
    own = {x[:2]: set(chat_quotes._passages(chat_quotes.split_quotes(x[3])[0])) for x in m}
    want = {}
    for conv, turn, _, text in m:
        origins = []
        for _, run in chat_quotes.split_quotes(text)[1]:
            votes, whole = defaultdict(lambda: [False, 0, 0]), chat_quotes.hashed(run)
            for h, size in chat_quotes._passages(run).items():
                before = [t for (c, t), hashes in own.items() if c == conv and t < turn and h in hashes]
                if before:
                    vote = votes[max(before)]
                    vote[:] = [vote[0] or h == whole, vote[1] + 1, vote[2] + size]
            origins.append(max(((*v, t) for t, v in votes.items()), default=(None,))[-1])
        want[conv, turn] = (max((o for o in origins if o is not None), default=None), len(origins), sum(o is not None for o in origins))
    table = spark.createDataFrame(m, "conv_id long, turn long, role string, text string")
    assert {(x.conv_id, x.turn): (x.parent_turn, x.n_quotes, x.n_linked) for x in chat_quotes.format_chats(table).collect()} == want


def test_long_reply_chains(spark):
    m = [(7, k, "user", (f"> line {k - 1}\n" if k else "") + f"line {k}") for k in range(40)]
    found = chat_quotes.format_chats(spark.createDataFrame(m, "conv_id int, turn int, role string, text string")).collect()
    assert {r.turn: (r.root_turn, r.depth, r.place) for r in found} == {k: (0, k, k) for k in range(40)}


def test_reply_order_equals_a_walk(spark):
    """Random threads against a walk down from each root, eldest first."""
    r = random.Random(9)
    parents = {(conv, turn): r.choice([None, *range(turn)][-4:] if turn else [None]) for conv in (1, 2, 3) for turn in range(60)}
    rows = [(conv, turn, parent) for (conv, turn), parent in parents.items()]
    children = defaultdict(list)
    for conv, turn, parent in rows:
        if parent is not None:
            children[conv, parent].append(turn)
    want = {}

    def walk(conv, root, turn, depth):
        want[conv, turn] = (root, depth, sum(x[0] == root for (c, _), x in want.items() if c == conv))
        for child in sorted(children[conv, turn]):
            walk(conv, root, child, depth + 1)

    for conv, turn, parent in rows:
        if parent is None and children[conv, turn]:
            walk(conv, turn, turn, 0)
    found = chat_quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, parent_turn long")).collect()
    assert {(x.conv_id, x.turn): (x.root_turn, x.depth, x.place) for x in found} == want


def test_a_chain_of_a_hundred_thousand_turns(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("1 AS conv_id", "id AS turn", "IF(id = 0, NULL, id - 1) AS parent_turn")
    assert chat_quotes.reply_order(chain).where("root_turn = 0 AND depth = turn AND place = turn").count() == n


def test_large_ids_of_conversations_stay(spark):
    big = (1 << 53) + 1
    m = [(big, big, "start here"), (big - 1, big, "other start"), (None, None, "lost"), (big, big + 1, "> start here\nanswer"), (-big, 0, "x")]
    table = spark.createDataFrame([(c, t, "user", x, 1, "y") for c, t, x in m], "conv_id long, turn long, role string, text string, place int, last string").coalesce(1)
    found = {(r.conv_id, r.turn): r.parent_turn for r in chat_quotes.format_chats(table).collect()}
    assert found == {(c, t): big if t == big + 1 else None for c, t, _ in m}


def test_branches_stay_together(spark):
    """Replies to 1 and 2 alternate; by place each branch is whole. Columns of the working tables don't disturb."""
    m = [(0, "start"), (1, "> start\none"), (2, "> start\ntwo"), (3, "> one\nthree"), (4, "> two\nfour"), (5, "> three\nfive"), (6, "alone"), (7, "> four\nseven")]
    table = spark.createDataFrame([(1, k, "user", t, "x", 5, "y") for k, t in m], "conv_id long, turn long, role string, text string, own string, path int, root_turn string")
    assert [r.turn for r in chat_quotes.format_chats(table).orderBy("conv_id", "root_turn", "place").collect()] == [0, 1, 3, 5, 2, 4, 7, 6]


def test_many_attributions_take_linear_time():
    import time

    text = "On Monday, x wrote:\n" * 60_000 + "\n" * 60_000 + "> said"
    began = time.perf_counter()
    assert chat_quotes.split_quotes(text)[1] == [(1, "said")]
    assert time.perf_counter() - began < 20


def test_chat_query_loses_no_message(spark, small):
    assert queries.QUERIES["op8_quotation_linking"](spark, small).count() == spark.read.parquet(f"{small}/conversations.parquet").count()


def test_pipeline_keeps_what_each_stage_keeps(spark, small):
    """The stages one after the other against plain decisions on their inputs."""
    import corpus_pipeline as cp
    import public_tokenizers

    docs = spark.read.parquet(f"{small}/documents.parquet")
    clean = cp.drop_toxic(spark, docs, small).cache()
    scorer = toxicity.fit(docs, toxicity.train_rows(spark.read.parquet(f"{small}/labels.parquet")))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if scorer.score(r.text) < 0.5}
    varied = cp.drop_repetitive(spark, clean, small).cache()
    assert {r.doc_id for r in varied.collect()} == {r.doc_id for r in quality_rules.repetition_coverage(clean).where("kept").collect()}
    single = cp.drop_near_duplicates(spark, varied, small).cache()
    want = link_classes({r.doc_id: r.text for r in varied.collect()})
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(want.values()))
    assert clean.columns == varied.columns == single.columns == docs.columns
    packed = cp.run(spark, small).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in single.collect()}
    lengths = {r.doc_id: len(b) // 4 + 1 for r in single.collect() for b in packing.id_bytes([r.text], public_tokenizers.path("word_bpe_49k.json"))}
    total = defaultdict(int)
    for r in packed:
        total[r.doc_id] += r.length
    assert dict(total) == lengths
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1


def test_pipeline_takes_awkward_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(10)], "doc_id long, quality int, toxic int")
    for name, rows in (("awkward", None), ("empty", [])):
        at = f"{tmp_path}/{name}"
        data.table(spark, rows).write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        found = cp.run(spark, at).collect()
        assert bool(found) == (rows is None)
        assert all(0 < r.length <= 4096 for r in found)

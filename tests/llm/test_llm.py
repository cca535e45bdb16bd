import base64
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quillveil.llm import ann, bpe, components, fingerprint, jaccard, language, licenses, mixing, pii, queries, toxicity, warc
from quillveil.llm.text import shingle_sets

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
KINDS = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, size string, ids string"


def documents(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, len(t or ""), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KINDS)


ODD = [None, "", "  \n\t ", "one two", "a " * 30_000, "é😀 ß x", "same words in this text here", "same words in this text here", "x" * 50_000, "\x1c\x1f \x85", "+" * 2000 + "1" * 3000 + "@" * 2000]


def shingled(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts, ids=None):
    ids = ids or list(range(len(texts)))
    sets, parent = [shingled(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [ids[root(i)] for i in range(len(sets))]


def test_shingle_sets_are_those_of_words():
    rng = np.random.default_rng(0)
    texts = ODD + [" ".join(rng.choice(list("abcAB"), rng.integers(0, 40))) for _ in range(300)]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(shingled(t)) for t in texts]


def near_texts(rng, groups=30, n=60):
    out = []
    for g in range(groups):
        base = [f"w{g}x{i}" for i in range(int(rng.integers(5, n)))]
        for _ in range(int(rng.integers(1, 7))):
            own = list(base)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(len(own)))] = f"e{rng.integers(9)}"
            out.append(" ".join(own))
    return out + ["common passage of ten words that many texts do share " + f"z{i} y{i} v{i} u{i} t{i}" for i in range(40)]


def test_op1_equals_brute_force(spark):
    texts = near_texts(np.random.default_rng(2)) + [t for t in ODD if t is None or len(t) < 1000]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: (len(shingled(t)), c) for i, (t, c) in enumerate(zip(texts, brute_components(texts)))}


def test_op1_large_regions_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    texts = near_texts(np.random.default_rng(3), groups=3, n=30) * 1
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(60)]
    for _ in range(60):
        own = list(base)
        for _ in range(int(rng.integers(0, 5))):
            own[int(rng.integers(60))] = f"q{rng.integers(1000)}"
        texts.append(" ".join(own))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_op1_repeated_rows_reused_ids_and_long_texts(spark, monkeypatch):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    long = " ".join(f"l{i}" for i in range(9000))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (5, long), (5, long), (6, long + " end"), (0, b + " more"), (9, "x" * 60_000), (8, "a " * 30_000), (7, None), (7, "")]
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    root = dict(zip(ids, ids))
    for _ in rows:  # rows of one doc_id are one document
        for i, c in zip(range(len(rows)), brute_components(texts, list(range(len(rows))))):
            low = min(root[ids[i]], root[ids[c]])
            root[ids[i]] = root[ids[c]] = low
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sketch string")
    for block in (512, 2):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
        assert got == sorted((i, len(shingled(t)), root[i]) for i, t in rows)


def test_op1_empty(spark):
    assert jaccard.near_duplicates(documents(spark, [])).count() == 0


def test_local_links_with_many_pivots():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(80)]
    parent = list(range(80))

    def root(p, i):
        while p[i] != i:
            i = p[i]
        return i

    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(parent, i), root(parent, j)
                parent[max(a, b)] = min(a, b)
    got = list(range(80))
    for i, j in jaccard.local_links(sets):
        a, b = root(got, i), root(got, j)
        got[max(a, b)] = min(a, b)
    assert [root(got, i) for i in range(80)] == [root(parent, i) for i in range(80)]


def test_reachable_keeps_all_links():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: 300 - k], rng.integers(0, 2**63, k).astype(np.uint64)))) for k in range(0, 60, 4)] + [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(20)]
    near = jaccard.reachable(np.array([len(s) for s in sets]), [jaccard.sketch(s) for s in sets])
    for i, s in enumerate(sets):
        if any(i != j and 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t)) for j, t in enumerate(sets)):
            assert near[i]
    assert not near[-20:].all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


@pytest.fixture(scope="module")
def encoder():
    with open(queries.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op2_equals_tiktoken_and_round_trips(spark, encoder):
    rng = np.random.default_rng(7)
    texts = [t for t in ODD if t is None or len(t) < 40_000] + ["".join(map(chr, rng.choice([*range(32, 127), 233, 0x4E2D, 0x1F600, 10, 9], 40))) for _ in range(300)] + ["<|endoftext|> don't 12345  x"]
    df = documents(spark, texts)
    coded = bpe.decode(bpe.encode(df, queries.VOCABULARY, public_tokenizers.PATTERN), queries.VOCABULARY, public_tokenizers.PATTERN)
    for r in coded.collect():
        t = texts[r.doc_id] or ""
        assert r.ids == encoder.encode_ordinary(t) and bytes(r.decoded).decode() == t and r.source == "s"
    assert bpe.digests(documents(spark, []), queries.VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(8).integers(0, 2**63, 5000).astype(np.uint64)
    assert sorted(bpe.PerfectHash(keys)(keys).tolist()) == list(range(5000))


def test_op3_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 3000)] + 0.3 * rng.standard_normal((3000, 16))
    x[5:40] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, None), (10_100, [0.0] * 16), (10_200, [float("nan")] * 16), (10_300, [1.0, None] * 8), (10_400, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {}
    for r in ann.search(df, df.where("id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        score = np.sqrt(((x - x[q]) ** 2).sum(1))
        score[q] = np.inf
        best = np.lexsort((np.arange(len(x)), score))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(score[v] == s for _, v, s in found)
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits >= 0.9 * 10 * len(got)
    assert [v for _, v, _ in got[0]] == list(range(5, 15))
    copies = df.where("id < 40").unionByName(spark.createDataFrame([(0, x[0].tolist())] * 14 + [(7, x[7].tolist())], "id long, vector array<double>")).withColumn("list", F.lit("clash"))
    found = ann.search(copies, copies.where("id % 100 = 0")).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in found] == list(zip(range(1, 11), [5, 6, 7, 7, 8, 9, 10, 11, 12, 13]))
    few = df.where("id in (0, 1, 2)")
    assert ann.search(few, few.where("id = 0")).count() == 2
    assert ann.search(df.where("false"), df.where("false")).count() == 0


def test_op4_against_sets(spark):
    texts = ODD + near_texts(np.random.default_rng(10), groups=5)
    rows = {r.doc_id: r for r in fingerprint.compare_edited(documents(spark, texts)).collect()}
    plain = [t or "" for t in texts]
    close = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for i, t in enumerate(plain):
        after = plain[(i + 1) % len(plain)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].near_edited == pytest.approx(close(shingled(t), shingled(edited))) and rows[i].near_next == pytest.approx(close(shingled(t), shingled(after)))
    assert rows[6].fingerprint == rows[5].fingerprint or texts[5] != texts[6]
    assert fingerprint.compare_edited(documents(spark, [])).count() == 0
    one = fingerprint.compare_edited(documents(spark, ["a b c"])).first()
    assert one.near_next == 1.0
    rows = [(2, "c c"), (None, "a b"), (1, "b b"), (2, "c c"), (1, "b a")]
    again = fingerprint.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash"))).collect()
    order = [(None, "a b"), (1, "b a"), (1, "b b"), (2, "c c"), (2, "c c")]
    edited = [t[: len(t) - len(t) // 2] + order[(i + 1) % 5][1][: len(t) // 2] for i, (_, t) in enumerate(order)]
    assert sorted((str(r.doc_id), r.edited_sha256) for r in again) == sorted((str(i), hashlib.sha256(e.encode()).hexdigest()) for (i, _), e in zip(order, edited))


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(11)
    a, b = (rng.integers(0, 2**32, 20_000).astype(np.uint32) for _ in range(2))
    b[:10_000] = a[:10_000]
    x, y = fingerprint.bottom(a), fingerprint.bottom(b)
    assert (fingerprint.merge(x, y) == fingerprint.bottom(np.concatenate((a, b)))).all()
    assert abs(fingerprint.resemblance(x, y) - 1 / 3) < 0.15 and abs(fingerprint.containment(x, y) - 0.5) < 0.2 and abs(fingerprint.distinct(x) / 20_000 - 1) < 0.3
    assert (fingerprint.from_text(fingerprint.to_text(x)) == x).all()


def test_op5_round_trip(spark):
    big = "é" * 600
    html = [big, big, None, "", "small", "small", "WARC/1.1\r\n\r\n" * 200, big, "filedesc: x\n" * 99]
    urls = ["http://a/ b", None, "http://c/%20", "http://d/#page=9", "e", "f", "g", "http://h/?q=1 2", "i"]
    rows = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(zip(urls, html))], "page_id long, url string, html string, archive string")
    got = {r.page_id: r for r in warc.read_archives(spark.read.parquet(warc.write_archives(spark, rows))).collect()}
    for i, h in enumerate(html):
        data = (h or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha1(data).hexdigest() and got[i].url == (urls[i] or "")
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {0: 7, 1: 7}
    assert warc.read_archives(spark.read.parquet(warc.write_archives(spark, rows.where("false")))).count() == 0


@pytest.mark.parametrize("few", [warc.FEW, 0])
def test_op5_repeated_rows_have_one_response_and_identifiers_of_their_own(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW", few)
    big, other = "b" * 1500, "c" * 1500
    rows = [(3, "u", big), (3, "u", big), (3, "t", big), (1, "u", big), (None, "u", big), (4, "v", "s"), (4, "v", "s"), (None, None, other), (None, None, other), (9, "w", other + "d")]
    got = warc.read_archives(spark.read.parquet(warc.write_archives(spark, spark.createDataFrame(rows, "page_id long, url string, html string")))).collect()
    assert len({r.record_id for r in got}) == len(rows)
    assert sorted((r.page_id or 0, r.url, r.record_type, r.refers_to or 0) for r in got) == sorted([(3, "u", "response", 0), (3, "u", "revisit", 3), (3, "t", "revisit", 3), (1, "u", "revisit", 3), (0, "u", "revisit", 3), (4, "v", "response", 0), (4, "v", "response", 0), (0, "", "response", 0), (0, "", "revisit", 0), (9, "w", "response", 0)])


@pytest.mark.parametrize("version", [1, 2])
def test_archives_from_elsewhere_are_converted(spark, version):
    data = warc.arc_header(version, "x.arc") + warc.arc_record(version, "http://a/", b"one") + warc.arc_record(version, "http://b/", b"one", date="20010203040506")
    rows = warc.read_archives(warc.convert(spark.createDataFrame([(bytearray(data),)], "archive binary"))).collect()
    assert [(r.url, r.payload_bytes, r.record_type, r.date[:10]) for r in rows] == [("http://a/", 3, "response", "1996-01-01"), ("http://b/", 3, "response", "2001-02-03")]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions_and_broken_files(version):
    data = warc.arc_header(version, "x.arc") + warc.arc_record(version, "http://a b/c", b"line\n\nline") + warc.arc_record(version, "http://d/", b"")
    assert [(r.url, r.payload) for r in warc.read_arc(data)] == [("http://a b/c", b"line\n\nline"), ("http://d/", b"")]
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-3].replace(b" 0\n", b" 9\n")))
    with pytest.raises(ValueError):
        list(warc.read_arc(b"nothing\n"))


def test_op6_targets_and_taken(spark):
    rng = np.random.default_rng(12)
    rows = [(i, None if i == 0 else " ".join("w" * int(rng.integers(0, 9))), [None, "b", "a", "Z", "é", "tiny"][min(5, i % 6 if i < 600 else 2)], "x") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(df).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    assert again == {r.doc_id: r.taken for r in got} and not any("Python" in x or "Arrow" in x for x in [mixing.mix(df)._jdf.queryExecution().executedPlan().toString()])
    sources = sorted({r[2] for r in rows if r[2]}) + [None]
    size = {s: sum(len(WORD.findall(r[1] or "")) for r in rows if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, capped = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        total = sum(weight[s] for s in sources if s not in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / total for s in sources}
        over = {s for s in sources if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for r in got:
        s = rows[r.doc_id][2]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        assert r.positions == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions) and (r.taken > 0) == (r.position is not None)
    for s in sources:
        assert abs(sum(r.taken for r in got if rows[r.doc_id][2] == s) - target[s]) <= 1
        drawn = sorted((p, q) for r in got if rows[r.doc_id][2] == s for p, q in zip(r.positions, r.parts, strict=True))
        slope = 1 - 2 * sources.index(s) / (len(sources) - 1)
        before = 0
        for t, part in drawn:  # the integral of the source's rate at a position is what the mix took before it
            assert target[s] * (t + slope * t * (1 - t)) == pytest.approx(before, abs=1e-6 * target[s] + 1e-6)
            before += part
    assert mixing.mix(df.where("false")).count() == 0


def test_first_words(spark):
    row = spark.range(1).select(*(mixing.first_words(F.lit(" a  b\nc d"), F.lit(n)).alias(str(n)) for n in (0, 1, 3, 9))).first()
    assert tuple(row) == ("", " a", " a  b\nc", " a  b\nc d")


def test_op7_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op7_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.96


def test_toxicity_grammar():
    reader = toxicity.Reader(toxicity.Model({"idio": 3.0}, {"scum": 3.0}, ()))
    score = lambda t: reader.features(t)[0]
    assert score("you are an idiot") > score("an idiot came") > score("they said an idiot came") > score("this is not an idiot") > score("fine words")
    assert score("I will kill you. Fine.") > 0 and score("scums") == 0 and score("scum") > 0 and score("IDIOTIC!") > 0
    assert toxicity.compose(toxicity.negation(), toxicity.insult(), "ihunro").run("noi") == [0.0, 0.0, 0.1]


def test_toxicity_grammar_equals_plain_rules_on_all_short_clauses():
    def plain(clause):
        out = []
        for t, s in enumerate(clause):
            near = [p for p in range(max(0, t - 3), t) if clause[p] == "n" and not set(clause[p + 1 : t]) & set("ih")]
            before = clause[:t]
            pay = 0.0
            if s == "i":
                pay = 0.1 if near else 0.4 if "r" in before else 1.5 if "u" in before else 1.0
            elif s == "h":
                pay = 0.1 if near else 0.4 if "r" in before else 2.5 if "u" in before else 1.5
            out.append(pay)
        return out

    for n in range(1, 7):
        for clause in map("".join, itertools.product("ihunro", repeat=n)):
            assert toxicity.grammar().run(clause) == pytest.approx(plain(clause)), clause


def test_op7_learns_one_text_of_each_id(spark):
    rows = [(i, f"you idiot number {i}" if i % 2 else f"fine day number {i}") for i in range(1, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    kinds = "doc_id long, text string"
    once = toxicity.train(spark.createDataFrame(rows, kinds), labels)
    assert toxicity.train(spark.createDataFrame(rows + [(1, rows[0][1])] * 500, kinds), labels) == once and "idi" in once.stems | once.whole


def test_long_clauses_are_read_once_and_whole():
    reader = toxicity.Reader(toxicity.Model({"idio": 3.0}, {}, ()))
    score = lambda t: reader.features(t)[0]
    long = "plain words, " * 60
    for before in ("they said ", "you "):
        assert score(f"Fine. {before}{long}an idiot came. Fine") == score(f"{before}an idiot came") != score("an idiot came")
    assert score(f"an idiot {long[:390]} an idiot {long[:390]} an idiot. An idiot {long}") == pytest.approx(4 * score("an idiot"))


def test_texts_without_a_match_are_not_toxic():
    rng = np.random.default_rng(21)
    texts = [" ".join(f"{c}{rng.integers(900)}" for c in "abcdefgh") for _ in range(60)]
    model = toxicity.learn(texts, [int(i % 6 > 0) for i in range(60)])
    assert toxicity.probability(np.zeros((1, 3)), model.coefficients)[0] < 0.5


def test_op7_edges(spark):
    df = documents(spark, ODD)
    labels = spark.createDataFrame([(0, None), (1, 1)], "doc_id long, toxic int")
    for model in (toxicity.train(df, labels), toxicity.train(df, labels.where("false"))):
        rows = toxicity.score(df, model).collect()
        assert len(rows) == len(ODD) and all(r.predicted == 0 for r in rows)
    assert toxicity.score(df.where("false"), model).count() == 0


def test_op8_held_out_accuracy_and_mixtures(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(df)
    rows = language.predict(df, model).where(language.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98
    en, de = (next(r.text for r in rows if r.lang == x and len(r.text) > 1500)[:1000] for x in ("en", "de"))
    mixed = language.predict(documents(spark, [en + " " + de, *ODD, "123 456"]), model).orderBy("doc_id").collect()
    assert {x.split(":")[0] for x in mixed[0].languages.split(",")} == {"en", "de"}
    assert {r.lang_pred for r in language.predict(documents(spark, ["½ ² Ⅷ", "٣ 4", "_ - ̈", "\u3007"]), model).collect()} == {"und"}
    assert [r.lang_pred for r in mixed[1:4]] == ["und"] * 3 and mixed[-1].lang_pred == "und" and mixed[-1].score == 0
    none = language.train(df.where("false"))
    assert language.predict(documents(spark, ["abc"]), none).first().lang_pred == "und"
    assert language.predict(df.where("false"), model).count() == 0


def test_a_document_can_mix_all_languages():
    windows = np.repeat(np.where(np.eye(7)[:6] > 0, -50.0, -90.0), 20, axis=0)
    shares, chosen = language.infer(windows, np.array([0, len(windows)]))
    assert chosen[0].tolist() == [True] * 6 + [False] and shares[0, :6] == pytest.approx(1 / 6)


def test_mixture_equals_plain_enumeration():
    rng = np.random.default_rng(23)

    def plain(rows, members):
        share = dict.fromkeys(members, 1 / len(members))
        for _ in range(12):
            held = [{j: share[j] * math.exp(row[j] - max(row)) for j in members} for row in rows]
            share = {j: sum(h[j] / sum(h.values()) for h in held) / len(rows) for j in members}
        return share, sum(max(row) + math.log(sum(share[j] * math.exp(row[j] - max(row)) for j in members)) for row in rows)

    k, docs = 4, []
    for _ in range(60):
        own = rng.choice(k, int(rng.integers(1, k + 1)), replace=False)
        rows = rng.normal(-90, 2, (int(rng.integers(2, 40)), k))
        rows[np.arange(len(rows)), rng.choice(own, len(rows))] += 12
        docs.append(rows)
    shares, chosen = language.infer(np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs]))))
    for rows, share, held in zip(docs, shares, chosen):
        sets = [m for n in range(1, k + 1) for m in itertools.combinations(range(k), n)]
        value = {m: plain(rows, m)[1] - 3.0 * math.log(len(rows) + 1) * len(m) for m in sets}
        own = tuple(np.flatnonzero(held))
        assert value[own] == pytest.approx(max(value.values())) and [share[j] for j in own] == pytest.approx([plain(rows, own)[0][j] for j in own])


def test_op9_equals_edit_distance_to_every_template():
    rng = np.random.default_rng(24)
    templates = [(t.license, t.words, t.text) for t in licenses._templates()[0]]

    def distance(a, b):
        """Words of a missing and words added, up to the end of the best prefix of b."""
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(last[j] if x == y else 1 + min(last[j + 1], row[j]))
        return min(row)

    for name, words, text in templates:
        for _ in range(3):
            own = text.split()
            inner = [i for i in range(3, len(own) - 2) if not any(c in own[i] for c in licenses.CUES)]
            for i in rng.choice(inner, min(len(inner), len(own) // 25), replace=False) if inner else ():
                own[i] = f"{own[i]} zu" if rng.random() < 0.5 else "zu"
            notice = " ".join(own)
            body = licenses._WORD.findall(notice)
            cost = {}
            for other, theirs, _ in templates:
                if len(theirs) <= len(body) + 9:
                    cost[other] = min(cost.get(other, 9**9), distance(theirs, body) - len(theirs))
            best = {x for x, c in cost.items() if c == min(cost.values())}
            found = licenses.scan(f"Some words here.\n{notice}\nOther words there.")
            assert len(found) == 1 and found[0].license in best and name in best, (name, notice, found, best)


def test_op9_notices(spark):
    texts = [*ODD, "Words.\nReleased under the MIT License.\nMore", "x. Licensed under CC BY-NC 4.0.", "This is no license at all, said she", licenses.TEMPLATES["MIT"][1].upper() + "\nLicensed under the Apache License, Version 2.0."]
    rows = licenses.find(documents(spark, texts)).orderBy("doc_id").collect()
    found = [[x.license for x in r.licenses] for r in rows]
    assert found[: len(ODD) + 1] == [[]] * len(ODD) + [["MIT"]] and found[len(ODD) + 1 :] == [["CC-BY-NC-4.0"], [], ["MIT", "Apache-2.0"]]
    one = rows[len(ODD)].licenses[0]
    assert texts[len(ODD)][one.start : one.end] == "Released under the MIT License" and one.missing == one.added == 0
    assert licenses.find(documents(spark, [])).count() == 0


@pytest.mark.parametrize("before", ["All pictures and texts that appear on these pages are ", "as they wrote, " * 20])
def test_notices_within_a_sentence_are_found(before):
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            found = licenses.scan(f"One. {before}{t} More words.")
            assert [(x.license, x.start, x.missing, x.added) for x in found] == [(name, 5 + len(before), 0, 0)]


def test_tags_and_cues_of_licenses():
    assert all(any(c in t.text for c in licenses.CUES) for t in licenses._templates()[0])
    found = licenses.scan("// SPDX-License-Identifier: GPL-2.0-or-later\n# SPDX-License-Identifier: MIT\nSPDX-License-Identifier: none")
    assert [x.license for x in found] == ["GPL-2.0", "MIT"]


def test_every_likely_template_is_compared(monkeypatch):
    monkeypatch.setattr(licenses, "gain", lambda block, i: 0.9 - i / 100)  # by rank, the right one is last
    assert [x.license for x in licenses.scan("This is free and unencumbered software released into the public domain.")] == ["Unlicense"]


def brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(out)


def test_op10_base_spans_equal_the_patterns():
    rng = np.random.default_rng(13)
    for _ in range(4000):
        t = "".join(rng.choice(list("a1@.- +()_%é2"), int(rng.integers(0, 40))))
        assert [tuple(s) for s in pii.base_spans(t)] == brute_spans(t), t
    t = "x@y.z 10.1.2.3 4532015112830366 +1 (614) 555-8001 a.b@c.d_e@f.g"
    assert [tuple(s) for s in pii.base_spans(t)] == brute_spans(t)


def test_op10_edges_and_masking(spark):
    texts = [*ODD, "call (614) 555-8001 or 614-555-8001", "a@b.com, +1 (614) 555-8001"]
    rows = pii.find(documents(spark, texts)).orderBy("doc_id").collect()
    assert all(set(map(tuple, r.base_spans)) <= set(map(tuple, r.spans)) for r in rows)
    assert len(rows[len(ODD)].spans) > 0
    out = {r.doc_id: r.text for r in pii.masked(documents(spark, texts)).collect()}
    assert out[0] is None and out[len(ODD) + 1] == "[EMAIL], [PHONE]" and out[4] == ODD[4]
    assert pii.find(documents(spark, [])).count() == 0


def test_pii_network_learns():
    net = pii.train()
    xs, ys = pii.examples(400, np.random.default_rng(99))
    tags = pii.viterbi(pii.emissions(net, xs), net.moves)
    assert (tags == ys)[ys > 0].mean() > 0.8


def test_pii_reads_long_addresses_whole_as_windows_over_the_whole_text_do(monkeypatch):
    filler = "Thlyouble the is of inesea ononedth edshhe thes onrein ndwhst thouinor. " * 3
    addresses = ["sales (at) international-trading-partners (dot) com", "firstname.middlename.lastname.department [at] example [dot] com", "sales (at) international (dot) co (dot) uk", "an.er@the-ion (dot) com"]
    texts = [f"{a}write to {x} now{b}" for x in addresses for a in ("", filler) for b in ("", " " + filler)] + [f"{filler}call (614) 555-8001{' ' * 50}or {filler}5" + filler, "@" * 3000, "a (at) " * 500]
    net = pii.train()
    base = [pii.base_spans(t) for t in texts]
    found = pii.added_spans(net, texts, base)
    for t, x, own in zip(texts, np.repeat(addresses, 4), found[:16]):
        assert x in [t[s.start : s.end] for s in own]
        assert pii.mask(t, [(pii.KINDS[s.kind], s.start, s.end) for s in own]).count("[EMAIL]") == 1
    monkeypatch.setattr(pii, "regions", lambda t: [(0, len(t))])
    assert found == pii.added_spans(net, texts, base)


def test_crf_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(14)
    scores, moves, tags = rng.standard_normal((4, 2, pii.TAGS)), rng.standard_normal((pii.TAGS, pii.TAGS)), rng.integers(0, pii.TAGS, (2, 4))
    _, ds, dm = pii._crf_gradient(scores, moves, tags)
    for at, g, x in (((1, 0, 3), ds, scores), ((2, 5), dm, moves)):
        x[at] += 1e-5
        up = pii._crf_gradient(scores, moves, tags)[0]
        x[at] -= 2e-5
        down = pii._crf_gradient(scores, moves, tags)[0]
        x[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_pipeline_against_brute_force(spark, encoder, tmp_path):
    base = " ".join(f"clean{i}" for i in range(40))
    texts = [base, base, base.replace("clean7 ", "other "), "you idiot scum moron " * 5 + base[:60], "mail a@b.com " + " ".join(f"z{i}" for i in range(30)), None, "", *(" ".join(f"t{k}x{i}" for i in range(20)) for k in range(8))]
    spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema) if name != "byte_bpe" else stage(spark, docs, str(tmp_path))
        after[name] = docs.collect()
    assert {r.doc_id for r in after["toxicity"]} == set(range(len(texts))) - {3}
    left = [i for i in range(len(texts)) if i != 3]
    roots = brute_components([texts[i] for i in left], left)
    assert {r.doc_id for r in after["ngram_jaccard_join"]} == {i for i, c in zip(left, roots) if i == c}
    assert next(r.text for r in after["pii"] if r.doc_id == 4).startswith("mail [EMAIL] z0")
    words = sum(len(WORD.findall(r.text or "")) for r in after["pii"])
    assert abs(sum(len(WORD.findall(r.text)) for r in after["mixing"]) - words) <= 2
    assert sorted(r.ids for r in after["byte_bpe"]) == sorted(encoder.encode_ordinary(r.text) for r in after["mixing"])


def test_pipeline_stages_keep_columns_of_any_name_and_take_empty_tables(spark, tmp_path):
    names = ("score", "predicted", "_text", "size", "positions")
    docs = spark.createDataFrame([(1, "plain words here", "s", 16, *"abcde"), (2, None, None, None, *"abcde")], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.without_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert corpus_pipeline.mixed(spark, docs, "").drop("text", "n_chars").collect()[0].score == "a"
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_pipeline_keeps_one_of_repeated_rows(spark):
    base = " ".join(f"clean{i}" for i in range(40))
    rows = [(5, base), (5, base), (7, base + " end"), (8, "alone " * 9), (8, "alone " * 9), (9, None), (9, None), (None, base), (10, "other text of more than five words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit("clash")).withColumn("rows", F.lit("clash"))
    kept = corpus_pipeline.one_of_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["10", "5", "8", "9", "None"]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_and_return_their_columns(spark, name):
    frame = queries.queries()[name](spark, SF)
    assert frame.count() > 0 and len(set(frame.columns)) == len(frame.columns)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op3_recall_on_the_tables(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    found = queries.op3_nearest_neighbours(spark, folder).collect()
    best = {}
    for q in {r.query_id for r in found}:
        score = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        score[ids == q] = np.inf
        best[q] = set(ids[np.lexsort((ids, score))[:10]])
    assert len(best) == (ids % 100 == 0).sum() and sum(r.vec_id in best[r.query_id] for r in found) >= 0.93 * 10 * len(best)

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.support import WORD, brute_components, brute_removed, shingles
from tidefold.llm import audio, chat, components, fingerprints, minhash, packing, pieces, quality, registry, shared, substring_dedup, tokens, url_filters, warc, words

DOC = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


def docs(spark, texts):
    rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# --- words -----------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\n\x0b\x1cé漢\xa0", max_size=60))
def test_words_are_those_of_the_pattern(text):
    data = text.encode()
    spans = [(s, e) for _, ss, ee in words.pieces(data, False) for s, e in zip(ss.tolist(), ee.tolist())]
    assert [data[s:e].decode() for s, e in spans] == WORD.findall(text)
    assert len(words.hash_words(data, True)) == len(spans)


def test_word_hashes_hold_over_pieces():
    text = ("abc " * 90_000 + "x" * 600_000 + " end").encode()
    h = words.hash_words(text, False)
    assert len(h) == 90_002 and len(set(h[:90_000].tolist())) == 1
    assert h[-1] == words.hash_words(b"end", False)[0]


# --- 1: url filters ----------------------------------------------------------------------


def test_urls(spark):
    cases = {
        "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://x.net": ("x.net", "", None, "allow"), "https://x.net/": ("x.net", "/", "net/", "block"),
        "a/b": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "x://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "x://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "x://o.org/fr/?a://b/": ("o.org", "/fr/", "org/fr/", "allow"), "x://h?q://z/": ("h", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_filters.judge_urls(pages, labels).orderBy("id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == list(cases.values())


def test_bad_hosts_are_blocked_and_unknown_ones_are_not(spark):
    rows = [(i, f"http://bad{i % 3}.spam.com/{i}") for i in range(60)] + [(100 + i, f"http://good{i % 3}.fine.com/{i}") for i in range(60)] + [(300, "http://new.fine.com/"), (None, "http://bad0.spam.com/"), (301, "http://other.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("lower", F.lit("clash"))
    labels = spark.createDataFrame([(i, 0, 0) for i in range(60)] + [(100 + i, 1, None) for i in range(60)] + [(100, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["host"]: r["verdict"] for r in url_filters.judge_urls(pages, labels).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"bad0.spam.com", "bad1.spam.com", "bad2.spam.com"}
    assert url_filters.judge_urls(pages.limit(0), labels.limit(0)).count() == 0


# --- 2: near duplicates --------------------------------------------------------------------


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    r, texts = random.Random(percent), [None, "", " \n", "a b", "A  B", "a b c", "one two three four five", "One two three four FIVE"]
    for base in (prose(r, 120), prose(r, 60), prose(r, 300)):
        for edits in (0, 0, 1, 1, 2, 2, 3, 4, 5, 6):
            ws = base.split(" ")
            for _ in range(edits):
                ws[r.randrange(len(ws))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(ws))
    chain = prose(r, 200).split(" ")
    for i in range(12):
        texts.append(" ".join(chain))
        chain[15 * i : 15 * i + 2] = [f"c{i}", f"d{i}"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    rows.append((None, texts[20]))
    df = spark.createDataFrame(rows, DOC).withColumns({"id": F.lit("clash"), "key": F.lit(1)})
    got = minhash.near_duplicates(df, percent=percent).collect()
    assert len(got) == len(rows)
    assert {x["id"]: x["component"] for x in got if x["id"] is not None} == brute_components(rows, percent)
    assert {x["id"]: x["n_shingles"] for x in got if x["id"] is not None} == {i: len(shingles(t)) for i, t in rows if i is not None}
    assert [x["component"] for x in got if x["id"] is None] == [None]


def test_near_duplicates_of_a_large_group(spark):
    """Many edits of one text that is itself missing: most pairs with the pivot are no links."""
    r = random.Random(5)
    base, texts = prose(r, 150).split(" "), []
    for _ in range(300):
        ws = list(base)
        for _ in range(r.randrange(1, 6)):
            ws[r.randrange(len(ws))] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(ws))
    got = {x["id"]: x["component"] for x in minhash.near_duplicates(docs(spark, texts), percent=85).collect()}
    assert got == brute_components(list(enumerate(texts)), 85)


def test_cells_give_no_more_links_than_components():
    to, r = zstandard.ZstdCompressor(), random.Random(16)
    family, other = prose(r, 200), prose(r, 200)
    texts = [f"{family} e{i}" for i in range(40)] + [f"{other} e{i}" for i in range(40)] + [prose(r, 200) for _ in range(5)]
    rows = [(i, i, g, to.compress(t.encode())) for g in (False, True) for i, t in enumerate(texts)]
    rows += [(100 + i, 0, False, to.compress(f"{family} f{i}".encode())) for i in range(3)]
    cell = pa.table(dict(zip(("id", "comp", "guest", "z"), map(list, zip(*rows)))))
    got = minhash._cell(5, 80)(cell).to_pylist()
    want = brute_components([(i, t) for i, t in enumerate(texts)], 80)
    comp = {x[0]: x[1] for x in rows}
    root = {c: c for c in comp.values()}
    for x in got:
        a, b = root[comp[x["a"]]], root[comp[x["b"]]]
        assert a != b
        root = {c: min(a, b) if y in (a, b) else y for c, y in root.items()}
    assert root == want and len(got) == 39 + 39


def test_near_duplicates_of_two_families_in_a_bucket(spark, monkeypatch):
    """The pivot's family is one component after a round, the other one after the next; cells alone find the same."""
    r = random.Random(17)
    head, rows = prose(r, 130), []
    for f in range(2):
        tail = prose(r, 30).split(" ")
        rows += [f"{head} {' '.join(tail)} x{i}" for i in range(40 - 10 * f)]
    found = brute_components(list(enumerate(rows)), 85)
    assert len(set(found.values())) == 2
    for rounds in (1, 2):
        monkeypatch.setattr(minhash, "PIVOTS", rounds)
        assert {x["id"]: x["component"] for x in minhash.near_duplicates(docs(spark, rows), percent=85).collect()} == found


def test_rows_of_an_id_join_their_texts(spark):
    """doc 5 has the texts of 3 and of 4, doc 8 an own text and a near copy of 4's; neither id represents both of its texts."""
    r = random.Random(15)
    a, b, c = (prose(r, 100) for _ in range(3))
    rows = [(3, a), (4, b), (5, a), (5, b), (6, c), (8, c), (8, b + " end"), (9, prose(r, 50)), (2, None), (2, "one two")]
    got = {(x["id"], x["component"]) for x in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(3, 3), (4, 3), (5, 3), (6, 3), (8, 3), (9, 9), (2, 2)}


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert minhash.near_duplicates(docs(spark, [None, ""])).count() == 2


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3), (5, 4)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 3: WARC -------------------------------------------------------------------------------


def keys(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string").select(warc.capture_key(F.col("url")).alias("key"))


def test_warc_round_trip_and_look_up(spark):
    big = "x" * 300
    rows = [(1, "http://www.b.org/P?q#f", big), (0, "http://a.com/", big), (2, "http://a.com/", "short"), (3, None, None), (4, "http://a.com/\r\nX: y", "short"), (5, "http://c.net/é", "é" * 100), (None, "http://a.com/", big), (0, "http://a.com/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"first": F.lit(9), "digest": F.lit("clash"), "key": F.lit("clash")})
    path = shared.new_path(spark, "test")
    captures = warc.write_archives(pages, path, most=200)
    assert captures.select("file").distinct().count() > 2  # archives are bounded by bytes
    index = warc.build_index(captures, f"{path}-index")
    asked = pages.select(warc.capture_key(F.col("url")).alias("key"))
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in warc.read_records(warc.look_up(index, asked), payload=True).collect())
    assert got == sorted([("1", 300, "revisit", 0, None), ("0", 300, "response", None, big), ("0", 300, "response", None, big), ("2", 5, "response", None, "short"), ("3", 0, "response", None, ""), ("4", 5, "response", None, "short"), ("5", 200, "response", None, "é" * 100), ("None", 300, "revisit", 0, None)])
    found = warc.read_records(warc.look_up(index, keys(spark, "https://A.com/#x", "HTTP://user@www2.a.com:80/", "http://nowhere.com/", "zzz://zzz/"))).collect()
    assert sorted(str(f["page_id"]) for f in found) == ["0", "0", "2", "None"]
    assert sorted(map(str, warc.scan_archives(spark, path).collect())) == sorted(map(str, captures.collect()))


def test_capture_keys(spark):
    urls = {"http://www.B.org:80/P?q#f": "org,b)/p?q", "x://u:p@a.b.c": "c,b,a)", None: ")", "no scheme": ")", "http://h?x": "h)?x", "http://a/ b%20C": "a)/bc", "http://a/" + "y" * 2000: None}
    got = [r["key"] for r in keys(spark, *urls).collect()]
    assert got[:-1] == list(urls.values())[:-1] and len(got[-1]) == warc.KEY_CHARS + 65


def test_index_of_many_blocks_and_a_key_that_is_everywhere(spark):
    r = random.Random(3)
    rows = [("hot)/" if r.random() < 0.4 else f"k{r.randrange(300)})/", i, "f", i * 10, 10) for i in range(3000)]
    captures = spark.createDataFrame(rows, warc.CAPTURE).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index = warc.build_index(captures, shared.new_path(spark, "test"), 50)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    directory = index.directory.collect()
    assert len(directory) >= 60 and sum(d["lines"] for d in directory) == 3000 and all(d["first_key"] <= d["last_key"] for d in directory)
    assert len([1 for low, high, _ in index.bounds if low <= "hot)/" <= high]) > 1
    asked = ["hot)/", "k7)/", "k299)/", "a)/", "zz)/"] + [f"k{i})/" for i in range(100, 200)]
    got = warc.look_up(index, spark.createDataFrame([(k,) for k in [*asked, None, "hot)/"]], "key string")).collect()
    assert sorted(map(tuple, got)) == sorted(x for x in rows if x[0] in asked)


def test_warc_of_records_beyond_a_member(spark, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1000)
    record = warc._record(7, "http://a/", b"\r\n\r\nWARC/1.1\r\n" * 500, "d", None)
    data = warc._members(record) + warc._members(warc._record(8, "", b"", "d", 7))
    read = list(warc.records(data))
    assert [r for _, _, r in read][0] == record and warc.parse(read[1][2])["refers_to"] == 7
    assert [warc.parse(r)["page_id"] for o, n, _ in read for _, _, r in warc.records(data[o : o + n])] == [7, 8]


def test_warc_of_nothing_and_of_very_long_pages(spark):
    path = shared.new_path(spark, "test")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.build_index(warc.write_archives(none, path), path)
    assert warc.read_records(warc.look_up(index, keys(spark, "http://a/"))).count() == 0
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh é") for _ in range(400_000)) * 6
    pages = spark.createDataFrame([(1, "http://a/" + "u" * 5000, long), (2, "http://a/", long + "x")], "page_id long, url string, html string")
    path = shared.new_path(spark, "test")
    index = warc.build_index(warc.write_archives(pages, path), f"{path}-index")
    got = warc.read_records(warc.look_up(index, pages.select(warc.capture_key(F.col("url")).alias("key")))).collect()
    assert {(x["page_id"], x["payload_digest"]) for x in got} == {(1, hashlib.sha256(long.encode()).hexdigest()), (2, hashlib.sha256((long + "x").encode()).hexdigest())}


# --- 4: packing ------------------------------------------------------------------------------

ODD = ["Don't <|endoftext|> STOP's", "İstanbul ΣΑΣ é", "a b x y ½ ²x", "日本語 ÀÉÎ ÷×\x1cfoo", "", " \n", "x" * 5000, "1234 a1b2 'll've", "é" * 50, "A\u0301 \u2003b"]


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole, own = Tokenizer.from_file(path), tokens.encoder(path)
    r = random.Random(2)
    cases = ODD + ["".join(r.choice("abcXYZ '.,!0é日ß\t\n<|>-") for _ in range(60)) for _ in range(300)]
    for text in cases:
        assert np.frombuffer(own.encode(text.encode()), np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_packing(spark):
    from tokenizers import Tokenizer

    r = random.Random(4)
    texts = [prose(r, r.choice([1, 30, 300, 3000])) for _ in range(40)] + [None, *ODD]
    rows = packing.pack(docs(spark, texts), packing.tokenizer_path(), group=20_000).collect()
    whole = Tokenizer.from_file(packing.tokenizer_path())
    by_doc, by_seq = {}, {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_seq.setdefault(x["sequence_id"], []).append(x)
    for i, text in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda x: x["start"])
        ids = [n for x in parts for n in np.frombuffer(bytes(x["ids"]), np.uint32).tolist()]
        assert ids == whole.encode(text or "", add_special_tokens=False).ids + [1]
        assert [x["start"] for x in parts] == np.cumsum([0, *(x["length"] for x in parts)])[:-1].tolist()
        assert {x["doc_tokens"] for x in parts} == {len(ids)}
    for parts in by_seq.values():
        parts.sort(key=lambda x: x["offset"])
        assert [x["offset"] for x in parts] == np.cumsum([0, *(x["length"] for x in parts)])[:-1].tolist()
        total = sum(x["length"] for x in parts)
        assert total <= 2048 and {x["sequence_tokens"] for x in parts} == {total}
    assert packing.pack(docs(spark, []), packing.tokenizer_path()).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_is_the_plain_rule(lengths):
    sequence, offset, n = packing.best_fit(lengths, 64)
    room, want = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [x for x in room if x >= lengths[i]]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 64) - lengths[i])
    assert n == len(room)
    used = [0] * n
    for s, x in zip(sequence, lengths):
        used[s] += x
    assert sorted(64 - u for u in used) == sorted(room)


# --- 5: pieces ---------------------------------------------------------------------------------


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    path = pieces.model_path()
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.transducer(path)
    r = random.Random(6)
    cases = ODD + ["".join(r.choice("abc eé \n\t日▁ĦX.,<>0 12  ") for _ in range(r.randrange(50))) for _ in range(800)] + [" " * i + "a" + " " * j for i in range(12) for j in range(12)]
    for text in cases:
        ids = np.frombuffer(own.encode(text), np.uint32).tolist()
        assert ids == library.encode(text), text
        assert own.decode(own.encode(text)).decode() == library.decode(ids)
    df = docs(spark, [None, "", "Hello  world\n", "a" * 200_000, "Hello  world\n"]).withColumns({"ids": F.lit(3), "id": F.lit("clash")})
    got = pieces.decode(pieces.encode(df, path), path).orderBy("doc_id").collect()
    assert [(x["text"], x["ids"]) for x in got] == [(None, 3), ("", 3), ("Hello  world\n", 3), ("a" * 200_000, 3), ("Hello  world\n", 3)]
    assert pieces.encode(df.limit(0), path).count() == pieces.round_trip(df.limit(0), path).count() == 0


def test_pieces_of_the_query(spark, sf):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in registry.QUERIES["op5_sentencepiece"](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text)
        data = np.array(ids, np.uint32).tobytes()
        assert (got[i]["n_ids"], got[i]["ids_crc32"], got[i]["decoded_sha256"]) == (len(ids), zlib.crc32(data), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_a_long_run_without_spaces():
    import sentencepiece

    t = pieces.transducer(pieces.model_path())
    r = random.Random(7)
    text = "ab" * 1_000_000 + "".join(r.choice("abcdefgé日0") for _ in range(100_000))
    assert np.frombuffer(t.encode(text), np.uint32).tolist() == sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()).encode(text)
    t.forget()
    assert not t.words and t.pairs.held == 0


def unigram(rules="identity", fold=False, prefix=True, suffix=False, fallback=False, seed=8):
    """A model put together by hand: a few pieces with weights by chance, and a normaliser of the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    r, model = random.Random(seed), sentencepiece_model_pb2.ModelProto()
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=name, score=0.0, type=kind)
    for i in range(256 if fallback else 0):
        model.pieces.add(piece=f"<0x{i:02X}>", score=0.0, type=6)
    mark = pieces.MARK
    for p in ["a", "b", "c", "ab", "ba", "bab", "aab", "abab", "fi", "f", "i", "é", mark, *((p + mark if suffix else mark + p) for p in ("a", "ab", "b"))]:
        model.pieces.add(piece=p, score=-r.uniform(1, 9), type=1)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.treat_whitespace_as_suffix = 1, fallback, suffix
    model.normalizer_spec.CopyFrom(sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_model_proto()).normalizer_spec)
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = fold, prefix
    return model


@pytest.mark.parametrize("options", [{}, {"fallback": True}, {"rules": "nmt_nfkc", "fold": True}, {"rules": "nmt_nfkc_cf", "prefix": False}, {"rules": "nfkc", "fold": True, "suffix": True, "fallback": True}])
def test_unigram_models_are_the_library(options):
    import sentencepiece

    model = unigram(**options)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), pieces.Transducer(model)
    r = random.Random(10)
    odd = ["a", "b", "c", "ab", "ba", " ", "  ", "\t", "\n", "ﬁ", "e\u0301", "Ａ", "Ⅷ", "日", "ΑΣ", "\u3000", "\u00a0", "\u200b", "½", "a\u0300", "😀", "ｶﾞ", "B"]
    cases = ["", " ", "   "] + ["".join(r.choice(odd) for _ in range(r.randrange(1, 15))) for _ in range(600)]
    for text in cases:
        ids = np.frombuffer(own.encode(text), np.uint32).tolist()
        assert ids == library.encode(text), text
        assert own.decode(own.encode(text)).decode(errors="replace") == library.decode(ids), text


def test_least_path_is_the_best_of_all():
    r = random.Random(8)
    for seed in range(30):
        model = unigram(seed=seed)
        t = pieces.Transducer(model)
        text = "".join(r.choice("ab") for _ in range(9))

        def every(rest):
            return [[]] if not rest else [[p, *q] for p in t.score if rest.startswith(p) for q in every(rest[len(p) :])]

        weight = lambda path: -sum(t.score[p] for p in path)
        got = [t.pieces[i] for i in np.frombuffer(t._path(text), np.uint32)]
        assert "".join(got) == text and weight(got) == pytest.approx(min(map(weight, every(text))))


def test_models_that_are_not_compiled():
    model = unigram()
    model.pieces.add(piece="own", score=0.0, type=4)
    with pytest.raises(ValueError):
        pieces.Transducer(model)


# --- 6: quality ----------------------------------------------------------------------------------


def brute_model(texts, n=quality.ORDER):
    from collections import Counter

    def units(t):
        u = np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), np.uint16).tolist()
        return [quality.START] * (n - 1) + u

    counts = Counter(tuple(u[i : i + n]) for u in map(units, texts) for i in range(len(u) - n + 1))
    levels = [counts]
    while len(levels) < n:
        levels.append(Counter(g[1:] for g in levels[-1]))
    tables = []
    for c in levels:
        of = Counter(c.values())
        n1, n2, n3, n4 = (of[i] for i in (1, 2, 3, 4))
        d = (0.5, 1.0, 1.5)
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            d = tuple(min(i + 0.95, max(0.05, x)) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)))
        ctx = {}
        for g, k in c.items():
            total, held = ctx.get(g[:-1], (0, 0.0))
            ctx[g[:-1]] = (total + k, held + d[min(k, 3) - 1])
        tables.append((c, ctx, d))

    def p(g, level=0):
        if level == n:
            return 1 / (len(levels[-1]) + 1)
        c, ctx, d = tables[level]
        lower = p(g[1:], level + 1)
        if g[:-1] not in ctx:
            return lower
        total, held = ctx[g[:-1]]
        k = c.get(g, 0)
        return ((k - d[min(k, 3) - 1] if k else 0) + held * lower) / total

    return lambda t: -sum(np.log(p(tuple(u[i : i + n]))) for u in [units(t)] for i in range(len(u) - n + 1))


def test_language_model_is_the_plain_one(spark):
    r = random.Random(9)
    texts = [prose(r, 40, 30) for _ in range(20)] + ["", None, "😀 unseen ZZZ", "#" * 50]
    trusted = range(12)
    df = docs(spark, texts).withColumns({"lang": F.lit("en"), "_row": F.lit(1), "n": F.lit("clash")})
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(13, 0, 0), (14, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    held, scores = quality.quality(df, labels)
    nll = brute_model([texts[i] for i in trusted])
    got = {x["id"]: x for x in scores.collect()}
    per = sorted(nll(texts[i]) / len(texts[i]) for i in trusted)
    bins = [np.ceil(x * quality.BINS) / quality.BINS for x in per]
    mid = bins[len(bins) // 2 - 1]
    for i, t in enumerate(texts):
        n = len((t or "").encode("utf-16-le")) // 2
        want = np.exp((nll(t) + quality.SHORT * mid) / (n + quality.SHORT))
        assert got[i]["perplexity"] == pytest.approx(want, rel=1e-9) and got[i]["n"] == n
    assert not got[23]["kept"] and all(got[i]["kept"] for i in trusted)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {i for i in got if got[i]["kept"]}


def test_quality_without_labels_or_rows(spark):
    df = docs(spark, ["a b", None]).withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(df, labels).count() == 2
    assert quality.keep_good(df.limit(0), labels).count() == 0


def test_quality_finds_bad_documents(spark, sf):
    got = quality.quality(spark.read.parquet(f"{sf}/documents.parquet"), labels := spark.read.parquet(f"{sf}/labels.parquet"))[1]
    j = got.join(labels, got.id == labels.doc_id).toPandas()
    good, bad = j[(j.quality == 1) & (j.toxic == 0)], j[(j.quality == 0)]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.5


def test_quality_finds_repetition(spark):
    """Repeated words and lines are likely characters; they are told by the text's own repetition."""
    r = random.Random(12)
    good = [prose(r, r.choice([8, 60, 300])) for _ in range(120)]
    junk = ["w12 " * 80, "w7 w8 " * 60, "w300 w41, w9 w55.\n" * 30, good[1] + " w5" * 400, "w31 w31 w45 w45 w45 w2 w2 w6 w6 w77 w77", "w250 " * 12]
    fine = [prose(r, n) for n in (5, 50, 500)] + ["w1 w1", good[0] + "\n" + good[1] + "\n" + good[0][:30], None, ""]
    df = docs(spark, good + junk + fine).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    for labels in ([(i, 1, 0) for i in range(100)], [(i, 1, 0) for i in range(100)] + [(120, 0, 0), (121, 0, 0)]):
        got = {x["id"]: x for x in quality.quality(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))[1].collect()}
        assert [i for i in range(120, 126) if got[i]["kept"]] == []
        assert all(got[i]["kept"] for i in range(126, len(got)))
    assert any(got[i]["perplexity"] <= got[i]["limit"] for i in range(120, 126))


def test_margin_follows_bad_documents(spark):
    """Documents labelled bad whose perplexity is within the widest margin are rejected, and so is what is like them."""
    r = random.Random(13)
    good = [prose(r, 100) for _ in range(60)]
    odd = [" ".join(w if r.random() < 0.9 else f"#{w}" for w in prose(r, 100).split()) for _ in range(10)]
    df = docs(spark, good + odd).withColumn("lang", F.lit("en"))
    trusted = [(i, 1, 0) for i in range(60)]
    wide, narrow = (
        {x["id"]: x for x in quality.quality(df, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), margin=3.0)[1].collect()} for rows in (trusted, trusted + [(i, 0, 0) for i in range(60, 65)])
    )
    assert all(x["kept"] for x in wide.values())
    assert not any(narrow[i]["kept"] for i in range(60, 65)) and sum(narrow[i]["kept"] for i in range(60)) >= 59


# --- 7: chat -------------------------------------------------------------------------------------


def test_best_paths(spark):
    rows = [(1, 1, None, 1.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, 1.0), (2, 1, 99, 0.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0), (None, 1, None, None)]
    rows += [(4, i, i - 1 if i else None, 1.0) for i in range(70)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = {}
    for x in chat.best_paths(df, None).collect():
        got.setdefault((x["tree"], x["path"]), []).append((x["depth"], x["node"]))
    want = {(1, 4): [1, 2, 4], (1, 5): [1, 3, 5], (2, 1): [1], (4, 69): list(range(70))}
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == want
    assert {(x["tree"], x["path"]) for x in chat.best_paths(df).collect()} == {(1, 4), (2, 1), (4, 69)}
    assert chat.best_paths(df.limit(0)).count() == 0


def test_template_is_reversible(spark):
    texts = ["<|im_end|>", "<\\|im_end\\|>", "<\\\\|x", "<|", "a\n<|im_start|>assistant\nb", "", "%0A", "<|im_end|>\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(chat.escaped(F.col("t")).alias("e"), "t").withColumn("back", chat.unescaped(F.col("e"))).withColumn("role", chat.unescaped_role(chat.escaped_role(F.col("t")))).collect()
    assert [x["back"] for x in got] == texts and [x["role"] for x in got] == texts and not any("<|" in x["e"] for x in got)
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "a\n%b", t, 1.0) for i, t in enumerate([*texts, None])]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = chat.format_trees(nodes).withColumn("turns", chat.parsed(F.col("text"))).first()
    assert [(t["role"], t["text"]) for t in out["turns"]] == [("assistant" if i % 2 else "a\n%b", t or "") for i, t in enumerate([*texts, None])]
    assert [chat.START in out["text"][s["start"] : s["start"] + s["length"]] for s in out["loss_mask"]] == [False] * 4


def test_repeated_and_null_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "x"), (None, 1, "assistant", "x")]
    out = chat.format_trees(chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).withColumn("n", F.size(chat.parsed(F.col("text"))))
    assert sorted((str(x["tree"]), x["n"]) for x in out.collect()) == [("1", 3), ("None", 1), ("None", 1)]


def test_links_are_those_of_the_chains(spark):
    rows = [(i % 4, i // 4, "user", f"t{i}") for i in range(30)] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = ["tree", "node", "parent", "score"]
    assert sorted(map(str, chat.chains(df).where("tree IS NOT NULL").select(names).collect())) == sorted(map(str, chat.chain_links(df).select(names).collect()))


def test_long_texts_and_clashing_columns(spark):
    """A turn of more than one part, spans over the bounds of parts, and columns named as those in between."""
    r = random.Random(4)
    texts = ["é<|" * 30_000, "a" * 65_530, "", "b😀" * 70_000, "end", "x"]
    rows = [(5, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("tree", "node", "parent", "score", "path", "depth", "piece", "own", "at")})
    out = chat.format_trees(chat.chains(df)).select("text", chat.parsed(F.col("text")).alias("turns"), chat.under(F.col("text"), F.col("loss_mask")).alias("loss")).collect()
    assert len(out) == 1 and [t["text"] for t in out[0]["turns"]] == texts and out[0]["loss"] == "".join(texts[1::2])
    assert chat.format_trees(chat.chains(df.limit(0))).count() == 0


# --- 8: substrings ---------------------------------------------------------------------------------


def test_levels():
    assert [substring_dedup.lengths(n) for n in (1, 7, 10, 11, 20, 50)] == [[1], [7], [5, 10], [6, 11], [5, 10, 20], [7, 13, 25, 50]]


def test_repeats_tell_windows_whose_first_hash_agrees():
    h, more = np.array([5, 5, 5, 9, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64)
    ids, start = np.array([3, 1, 2, 0, 1]), np.array([0, 4, 7, 0, 4])
    assert substring_dedup._repeats(h, more, ids, start).tolist() == [True, False, False, False, False]
    assert substring_dedup._least(h, more, ids, start).tolist() == [2, 1, 3]


def test_no_candidate_survives_the_first_level(spark):
    r = random.Random(1)
    texts = [prose(r, 60, 10**9) for _ in range(20)] + ["x y " * 30]
    got = {x["doc_id"]: x[substring_dedup.REMOVED] for x in substring_dedup.substring_dedup(docs(spark, texts)).collect()}
    assert got == {i: removed for i, (_, removed, _) in brute_removed(list(enumerate(texts)), 20).items()} and got[20] > 0


@pytest.mark.parametrize("n", [20, 7, 11])
def test_substring_dedup(spark, n, monkeypatch):

    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 3000)
    r = random.Random(n)
    passages = [prose(r, 25), prose(r, 60), "la " * 50]
    texts = [None, "", "short text", passages[0], " ".join(passages[0].split()[:19])]
    for i in range(40):
        parts = [prose(r, r.randrange(30)), r.choice(passages), prose(r, r.randrange(30))]
        if i % 7 == 0:
            parts.append(parts[1])
        texts.append("\n ".join(parts))
    rows = [(i if i % 13 else None, t) for i, t in enumerate(texts)] + [(7, texts[7]), (8, texts[9]), (9, prose(r, 40))]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "at long, doc_id long, text string").repartition(4).withColumn(substring_dedup.WORDS, F.lit("clash"))
    got = {x["at"]: x for x in substring_dedup.substring_dedup(df, n=n).collect()}
    for i, (count, removed, kept) in brute_removed(rows, n).items():
        assert (got[i][substring_dedup.WORDS], got[i][substring_dedup.REMOVED]) == (count, removed)
        assert WORD.findall(got[i]["text"] or "") == kept
        assert removed or got[i]["text"] == rows[i][1]


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.substring_dedup(docs(spark, [])).count() == 0


# --- 9: audio ----------------------------------------------------------------------------------------


def test_laws_and_adpcm():
    assert audio.LAWS["mulaw"][[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert audio.LAWS["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    r = np.random.default_rng(1)
    blocks = r.integers(0, 256, (7, 40), dtype=np.uint8)
    blocks[:, 2] %= 89
    got = audio.decode_adpcm(blocks)
    for row, out in zip(blocks, got):
        value, index = int(np.frombuffer(row[:2].tobytes(), "<i2")[0]), int(row[2])
        want = [value]
        for byte in row[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = audio.STEPS[index]
                change = step >> 3
                for bit, shift in ((4, 0), (2, 1), (1, 2)):
                    change += step >> shift if code & bit else 0
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + audio.TURNS[code & 7]))
                want.append(value)
        assert out.tolist() == want


def test_media_round_trip(spark):
    texts = [None, "", "a" * 192, "b" * 193, "é" * 500, *(f"text {i} " * i for i in range(30))]
    made = audio.with_sound(audio.media_column(docs(spark, texts).withColumns({"media": F.lit("clash"), "pcm": F.lit(1)})))
    assert sorted(map(str, made.collect())) == sorted(map(str, audio.media_and_sound(docs(spark, texts)).collect()))
    sounds = {x["id"]: bytes(x["pcm"]) for x in made.collect()}
    for x in audio.read_media(made).collect():
        data = (texts[x["id"]] or "").encode()
        full = data.ljust(max(1, -(-len(data) // 192)) * 192)
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        codec, _, sound = audio.decoded([audio.store(full)])[0]
        assert np.array_equal(audio.unpack_pcm(sounds[x["id"]]), sound) and len(sound) == int(x["feature"].split()[1])
        media = audio.store(full)
        assert (x["media_bytes"], x["media_sha256"], x["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), audio.feature(codec, sound))
    assert audio.read_media(audio.with_sound(audio.media_column(docs(spark, [])))).count() == 0


def test_media_of_the_query(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_telephony_audio"](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, data in texts.items():
        full = data.ljust(max(1, -(-len(data) // 192)) * 192)
        media = audio.store(full)
        (codec, _, sound), x = audio.decoded([media])[0], got[i]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (x["media_bytes"], x["media_sha256"], x["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), audio.feature(codec, sound))


def test_packed_sound_is_the_same(spark):
    r = np.random.default_rng(2)
    laws = [np.repeat(t[r.integers(0, 256, 500)], 2) for t in audio.LAWS.values()]
    for x in (np.zeros(0, np.int16), np.array([5], np.int16), r.integers(-32768, 32768, 1001).astype(np.int16), np.array([-32768, 32767, -32768] * 7, np.int16), *laws, audio.resample(laws[0], 8000, 16000)):
        assert np.array_equal(audio.unpack_pcm(audio.pack_pcm(x)), x)
    long = "".join(chr(97 + i % 7) for i in range(3_000_000))
    got = audio.read_media(audio.media_and_sound(docs(spark, [long, long + "x"]))).collect()
    assert {x["id"]: x["payload_sha256"] for x in got} == {i: hashlib.sha256(t.ljust(-(-len(t) // 192) * 192)).hexdigest() for i, t in enumerate((long.encode(), (long + "x").encode()))}


def test_resampling():
    x = np.array([0, 100, -100], np.int16)
    assert audio.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert audio.resample(x, 8000, 8000) is x and len(audio.resample(x, 11025, 16000)) == 4


# --- 10: fingerprints ----------------------------------------------------------------------------------


def folded(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"\s+", " ", t).strip(" ")


def test_fingerprints(spark):
    texts = ["Straße  ", "STRASSE", "ﬁne\n", "fine", "e\u0301", "É", None, "", " \t", "a b", "a\u00a0b", "ab", "😀x", "Ⅷ"]
    for bits in (128, 4):
        got = {x["doc_id"]: x["fingerprint"] for x in fingerprints.fingerprint(docs(spark, texts).withColumn("fingerprint", F.lit(1)), bits=bits).collect()}
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                assert (got[i] == got[j]) == (folded(a) == folded(b)), (a, b)
    assert got[0].split("-")[0] == f"{xxhash.xxh64_intdigest(folded(texts[0]).encode(), 42):016x}"[:1]
    assert fingerprints.fingerprint(docs(spark, [])).count() == 0


def test_edits(spark):
    r = random.Random(3)
    rows = [(i * 700 - 5000, prose(r, r.randrange(6))) for i in range(30)] + [(3, "same"), (4, "same"), (5, None), (9000, "😀😀😀"), (9000, "😀😀😀b"), (None, "loose one")]
    got = fingerprints.with_edit(spark.createDataFrame(rows, DOC).repartition(3)).collect()
    order = sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], (x[1] or "").encode()))
    want = []
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        m = len(t) // 2
        edited = t[: len(t) - m] + nxt[:m]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(folded(t) == folded(edited)), float(folded(t) == folded(nxt))))
    want.append((None, 9, hashlib.sha256(b"loose").hexdigest(), 0.0, None))
    assert sorted(((x["id"], x["n_chars"], x["edited_sha256"], x["near_edited"], x["near_next"]) for x in got), key=str) == sorted(want, key=str)
    assert fingerprints.with_edit(docs(spark, [])).count() == 0


def test_following(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "TOP_ROWS", 5)
    keys = sorted({random.Random(i).randrange(-(2**40), 2**40) for i in range(60)} | set(range(50)))
    got = {x["k"]: x["next"] for x in fingerprints.following(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()}
    assert got == dict(zip(keys, [*keys[1:], keys[0]]))

"""The text operators against brute force, on awkward rows: nulls, empty and very long texts, ties, repeats, empty tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tabularium.llm import pseudonyms as pii
from tabularium.llm import suffix_dedup
from tabularium.llm.code_search import nearest_codes, sign_code
from tabularium.llm.decontaminate import contamination, without_contaminated
from tabularium.llm.graph import connected_components
from tabularium.llm.licenses import license_matches
from tabularium.llm.main_text import best_run, extract_main_text, fit_weights, main_text
from tabularium.llm.pieces import Pieces, _gap, _scale, decode_pieces, encode_pieces, model_state
from tabularium.llm.pseudonyms import permute, pseudonymise, pseudonyms
from tabularium.llm.quality import classify, keep_good
from tabularium.llm.simhash import one_per_group, simhash_components
from tabularium.llm.suffix_dedup import _compared, _prefixes, _removed, _repeated, _run_rows, _sample_rows, repeated_bytes
from tabularium.llm.token_counts import UnigramCounter, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def awkward():
    rng = random.Random(7)
    base = words(rng, 300)
    texts = [None, "", " \n\t", "one", "one two", base, base, base.upper(), base + " tail", base.replace(" ", "\n", 5), words(rng, 5000),
             words(rng, 40) + base[100:400], "x" * 200, "y" + "x" * 120, base[:49], base[:50], "dé" * 60]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    rows += [(3, "one", None, None, None), (50, base[:50], None, "s1", 1), (5, words(rng, 20), "en", "s0", 2), (None, base, "en", "s0", 3), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


# 1: repeated bytes


def repeats(rows):
    spans = [(2**63 if i is None else i, i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for order, _, data in spans:
        for a in range(len(data) - 49):
            s = data[a : a + 50]
            first[s] = min(first.get(s, order), order)
    out = []
    for order, i, data in spans:
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - 49):
            if first[data[a : a + 50]] < order:
                gone[a : a + 50] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=key)


def test_repeated_bytes(docs, none):
    assert rows_of(repeated_bytes(docs)) == repeats(awkward())
    assert repeated_bytes(none).count() == 0


def test_repeated_bytes_in_small_buckets(spark):
    rng = random.Random(3)
    shared = [words(rng, 30) for _ in range(6)]
    rows = [(i, words(rng, rng.randint(0, 25)) + " " + rng.choice(shared)[rng.randint(0, 40) :] + words(rng, 4), "en", "s", 0) for i in range(60)]
    assert rows_of(repeated_bytes(spark.createDataFrame(rows, SCHEMA), bucket_bytes=500)) == repeats(rows)


def test_a_block_sends_a_common_phrase_once():
    rng = random.Random(4)
    phrase = words(rng, 40)
    texts = [f"{words(rng, 20)} {phrase} {words(rng, 20)}" for _ in range(200)]

    def block(texts, number):
        n = len(texts)
        numbers = pa.array(range(n), pa.int64())
        return pa.table({"k1": numbers, "k2": pa.array(range(n), pa.int32()), "id": numbers, "text": texts, "block": pa.array([number] * n, pa.int64())})

    one, many = block(texts[:1] + [words(rng, 60) for _ in range(199)], 0), block(texts, 1)
    assert [_sample_rows(7)(x).num_rows for x in (one, many)] == [7, 7]  # whatever the number of documents
    none = pa.table({"bucket": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())})
    rows = _run_rows(7, 1)(many, none)
    sent = b"".join(x for x in rows.column("text").to_pylist() if x)
    assert sent.count(phrase.encode()) == 1 and sum(x is not None for x in rows.column("pairs").to_pylist()) == 1
    assert _compared(rows).column("pairs").to_pylist() == [x for x in rows.column("pairs").to_pylist() if x]


def blocks_of(rows, n_blocks):
    """Rows in blocks, as ``repeated_bytes`` hands them to its steps; texts are different."""
    out = [[] for _ in range(n_blocks)]
    for k, (i, text, *_) in enumerate(rows):
        out[k % n_blocks].append((k, 0, i, text, k % n_blocks))
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("id", pa.int64()), ("text", pa.string()), ("block", pa.int64())])
    return [pa.table([pa.array(c, f.type) for c, f in zip(zip(*x), schema)], schema=schema) for x in out]


def by_blocks(rows, n_blocks, n_buckets, n_meets):
    """What the steps of ``repeated_bytes`` say of each text, one after the other in this process."""
    blocks = blocks_of(rows, n_blocks)
    own = lambda table, column, value: table.filter(pa.compute.equal(table.column(column), value))
    names = pa.concat_tables([_sample_rows(n_buckets)(x) for x in blocks])
    bits = pa.concat_tables([_repeated(own(names, "bucket", k)) for k in range(n_buckets) if own(names, "bucket", k).num_rows])
    runs = pa.concat_tables([_run_rows(n_buckets, n_meets)(x, own(bits, "block", k)) for k, x in enumerate(blocks)])
    later = pa.concat_tables([_compared(own(runs, "meet", k)) for k in range(n_meets) if own(runs, "meet", k).num_rows] or [pa.table({"block": pa.array([], pa.int64()), "pairs": pa.array([], pa.binary())})])
    done = pa.concat_tables([_removed(x, own(later, "block", k)) for k, x in enumerate(blocks)]).to_pylist()
    return sorted((x["id"], len(rows[x["k1"]][1].encode()), x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in done)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from(["ab", "abc de", "abcdeé  "]), st.integers(1, 5), st.integers(1, 4), st.integers(1, 6))
def test_steps_of_repeated_bytes_on_texts_of_few_letters(seed, letters, n_blocks, n_buckets, n_meets):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [piece(rng.randint(45, 160)) for _ in range(4)] + [piece(rng.randint(1, 14)) * 20]
    texts = {"".join(rng.choice(shared)[rng.randint(0, 30) :][: rng.randint(1, 150)] if rng.random() < 0.6 else piece(rng.randint(0, 60)) for _ in range(rng.randint(0, 6))) for _ in range(24)}
    rows = [(rng.randint(0, 20), x, None) for x in sorted(texts)]  # some have one id
    rows += [(30 + i, piece(70), None) for i in range(n_blocks)]  # no block without a row
    assert by_blocks(rows, n_blocks, n_buckets, n_meets) == repeats(rows)


def test_repeated_passages_are_not_compared_byte_by_byte(monkeypatch):
    rng = random.Random(8)
    passage = words(rng, 900)
    rows = [(i, f"{words(rng, 30)} {passage} {words(rng, 30)}", None) for i in range(12)]
    named = []
    monkeypatch.setattr(suffix_dedup, "_prefixes", lambda loads, at: named.append(len(at)) or _prefixes(loads, at))
    assert by_blocks(rows, 4, 2, 3) == repeats(rows)
    assert sum(named) < 0.1 * 12 * len(passage.encode())  # only around the ends of the passage


# 2: token counts


def test_token_counts_match_the_tokenizer(docs, none):
    state = model_state(MODEL)
    unigram = Tokenizer(models.Unigram(list(zip(state[0], state[1])), unk_id=0, byte_fallback=True))
    got = rows_of(token_counts(docs.withColumn("n_tokens", F.lit("clash")), MODEL).select("doc_id", "text", "n_tokens"))
    assert got == sorted(((i, t, len(unigram.encode("▁" + t.replace(" ", "▁")).ids) if t else 0) for i, t, *_ in awkward()), key=key)
    assert token_counts(none, MODEL).count() == 0


def test_token_counts_of_awkward_characters():
    state = model_state(MODEL)
    unigram = Tokenizer(models.Unigram(list(zip(state[0], state[1])), unk_id=0, byte_fallback=True))
    counter = UnigramCounter(state)
    for text in ["  ", "\n\n a", "\t▁x  ▁", "é\U0001f600​語", "a" * 3000]:
        assert counter.count(text)[1] == len(unigram.encode("▁" + text.replace(" ", "▁")).ids)


def test_ties_take_the_longest_last_piece():
    state = (["<unk>", "a", "b", "ab", "▁"], [0.0, -1.0, -1.0, -2.0, -1.0], [], 0)
    assert UnigramCounter(state).chunk("ab") == (-2.0, 1)


# 3: main text

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div id="cookie-notice">We use cookies</div><main><h1>A &amp; B</h1><p>one two<br>three  four
five<div class="ad">buy now</div><p>more words are here &eacute;<form>mail <input name=x> go</form><ul><li>first item<li>second item</ul>
<div class="comments"><p>a reader says a lot of things here and there</div></main><aside>x y z</aside><footer>&copy; c</footer>"""


def test_main_text():
    weights = fit_weights([])
    assert main_text(PAGE, weights) == "A & B\none two three four five\nmore words are here é\nfirst item\nsecond item"
    assert main_text(PAGE.replace("<main>", "<div>").replace("</main>", "</div>"), weights).startswith("A & B\none two three")
    assert [main_text(x, weights) for x in (None, "", "<p>", "<nav><a>only a menu</a></nav>", "just text")] == ["", "", "", "", "just text"]
    assert main_text('<p>cut off</p><p class="x', weights) == "cut off"


@pytest.mark.parametrize("start,end", [
    ('<h2 id="binary-search">', "</h2>"), ('<section id="related-work"><p>', "</section>"), ('<section id="social-history"><p>', "</section>"),
    ('<p class="notice">', "</p>"), ('<section id="search"><p>', "</section>"), ('<p>see <span class="search">', "</span></p>"),
    ('<div class="entry-content comments-enabled"><p>', "</div>"), ("<div class='has-sidebar'><p>", "</div>"), ('<p data-id="ad">', "</p>"),
])
@pytest.mark.parametrize("outer", ["article", "div"])
def test_ids_and_parts_of_class_words_drop_nothing(start, end, outer):
    page = f"<body><nav><a>Home</a></nav><{outer}><p>one two three four five six</p>{start}the words that count{end}<p>seven eight nine ten</p></{outer}></body>"
    assert "the words that count" in main_text(page, fit_weights([]))


def test_marked_containers_stay_out():
    for start in ('<div class="x ad">', "<div class=sidebar>", '<div role="navigation">', '<div id="footer">', '<ul class="breadcrumbs"><li>'):
        assert main_text(f"<body><div><p>one two three four five six</p></div>{start}buy these now", fit_weights([])) == "one two three four five six"


def test_many_values_in_one_text():
    lines = [f"mail u{i}@example.org from 10.0.{i % 250}.{i % 240} on 2024-03-{1 + i % 28:02d}" for i in range(6_000)]
    began = time.perf_counter()
    text, kinds = pseudonymise("\n".join(lines), b"k" * 32)
    assert time.perf_counter() - began < 30
    assert kinds == ["email", "ip", "date"] * 6_000
    alone = [pseudonymise(x, b"k" * 32)[0] for x in lines[:50] + lines[-50:]]
    assert text.split("\n")[:50] + text.split("\n")[-50:] == alone


BODY = "<body><article><p>one two three four five six seven</p>{}<p>eight nine ten eleven twelve</p></article></body>"


@pytest.mark.parametrize("piece, text", [
    ('<p title="the hidden truth">seen words</p>', "seen words"),
    ('<section aria-label="On hidden variables"><p>seen words</p></section>', "seen words"),
    ('<p class="md hidden lg-block">seen words</p>', "seen words"),
    ("<p hidden>gone</p>", ""), ("<p aria-hidden=TRUE>gone</p>", ""), ("<p style='color:red;display : none'>gone</p>", ""),
    ("<p data-t=don't>seen words</p>", "seen words"), ("<p data-t=don't>it's seen</p><p>so's this</p>", "it's seen\nso's this"),
    ('<p title="a > b">seen words</p>', "seen words"), ("<p a=\"1\" a='2' =x / b>seen words</p>", "seen words"),
    ("<p>un<wbr>broken, an<img src=x alt='y'>d cut<br>here</p>", "unbroken, and cut here"),
    ('<div id="comments"><p>first!</p></div>', ""), ('<ol class="comment-list"><li>first!</li></ol>', ""),
    ('<p class="ad">buy</p>', ""), ('<p>seen <span class="x advert">buy</span>words</p>', "seen words"),
    ('<h2 id="comments">seen words</h2>', "seen words"), ('<p class="ad-hoc">seen words</p>', "seen words"),
    ("<p><label>seen</label> words</p>", "seen words"), ("<form><label>name</label><input><p>send it</p></form>", ""),
])
def test_main_text_goes_by_parsed_attributes(piece, text):
    want = ["one two three four five six seven", text, "eight nine ten eleven twelve"]
    assert main_text(BODY.format(piece), fit_weights([])) == "\n".join(x for x in want if x)


def test_main_text_of_a_page_inside_a_form():
    inner = "<h1>seen title</h1><p>one two three four five</p><label>name</label><input><button>send</button>"
    assert main_text(f"<body><form action=x>{inner}</form></body>", fit_weights([])) == "seen title\none two three four five"
    assert main_text("<body><form><p>a b c d</p><p>e f g h</p><p>i j k l</p></form></body>", fit_weights([])) == "a b c d\ne f g h\ni j k l"


def test_best_run_equals_all_runs():
    rng = random.Random(5)
    for _ in range(300):
        scores = [float(rng.randint(-3, 3)) for _ in range(rng.randint(0, 14))]
        runs = [(-sum(scores[a:b]), b, b - a, a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1) if sum(scores[a:b]) > 0]
        best = min(runs, default=None)
        assert best_run(scores) == ((best[3], best[1]) if best else (0, 0)), scores


def test_main_text_of_a_very_long_page_and_of_repeated_pages(spark):
    page = "<body><nav><a>menu</a></nav><main>" + "".join(f"<p title='{i}\"'>word {i} it's</p>" for i in range(30_000)) + "</main>" + "<div " * 20_000
    rows = spark.createDataFrame([(1, page), (1, page), (2, '<p a="' * 20_000)], "page_id long, html string")
    got = extract_main_text(rows).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == ["\n".join(f"word {i} it's" for i in range(30_000))] * 2


def test_main_text_of_given_pages(tables, spark):
    def article(page):
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        import html

        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:h1|p)>", inner))
        return "\n".join(x for x in blocks if x)

    pages = tables.pages
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    assert got == {r["page_id"]: article(r["html"]) for r in pages.collect()}
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "<p>a b c</p>", None)], "page_id long, html string, text string")
    assert sorted(r["text"] for r in extract_main_text(odd).collect()) == ["", "", "a b c"]
    assert extract_main_text(odd.limit(0)).count() == 0


# 4: SimHash


def simhash(text):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] if len(parts) > 2 else [b" ".join(parts)] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(codes, ids):
    component = list(range(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3 and component[i] != component[j]:
                a, b = component[i], component[j]
                component = [b if c == a else c for c in component]
    return [min((ids[j] for j in range(len(ids)) if component[j] == component[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_simhash_components(docs, none):
    ids, codes = [r[0] for r in awkward()], [simhash(r[1]) for r in awkward()]
    want = sorted(zip(ids, [f"{c:016x}" for c in codes], grouped(codes, ids)), key=key)
    assert rows_of(simhash_components(docs)) == want
    assert simhash_components(none).count() == 0
    kept = [r["doc_id"] for r in one_per_group(docs).collect()]
    assert sorted(kept) == sorted(i for i, _, c in want if i == c and i is not None)  # the null ids have copies with an id


@pytest.mark.parametrize("large_bucket", [4096, 2])
def test_links_of_dense_codes(spark, large_bucket):
    from tabularium.llm.simhash import near_links

    rng = random.Random(1)
    codes = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        codes |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(25)}
    codes = sorted(codes)
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    edges = near_links(spark.createDataFrame([(c,) for c in signed], "code long"), large_bucket).collect()
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 3 for u, v in edges)
    parent = {c: c for c in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[max(find(u), find(v))] = min(find(u), find(v))
    want = grouped(codes, list(range(len(codes))))
    assert len({find(c) for c in signed}) == len(set(want))


def test_components_of_long_chains(spark):
    rng = random.Random(5)
    names = rng.sample(range(10_000), 400)
    edges = [(a, b) for a, b in zip(names, names[1:]) if a % 17] + [(1, 1)] + [(names[0], names[1])] * 3
    parent = {n: n for e in edges if e[0] != e[1] for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v and find(u) != find(v):
            parent[max(find(u), find(v))] = min(find(u), find(v))
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert rows_of(got) == sorted(((n, find(n)) for n in parent), key=key)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 5: code search


def test_nearest_codes(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(180)]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [(300, None), (None, rows[0][1]), (7, rows[9][1])]
    coded = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", sign_code("embedding").alias("code"))
    known = [(i, sum(1 << b for b, x in enumerate(v) if x > 0)) for i, v in rows if i is not None and v is not None]
    queries = coded.where("vec_id % 20 = 0")
    got = sorted(tuple(r) for r in nearest_codes(coded, queries, 5, block=64).collect())
    want = []
    for q, code in known:
        if q % 20 == 0:
            best = sorted(((c ^ code).bit_count(), i) for i, c in known)[:5]
            want += [(q, rank, i, d) for rank, (d, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert nearest_codes(coded.limit(0), queries, 5).count() == 0 and nearest_codes(coded, queries.limit(0), 5).count() == 0
    few = coded.where("vec_id < 3")
    assert nearest_codes(few, few, 10).count() == 9


# 6: quality


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = classify(docs, labels.where(half)).join(labels.where(~half), "doc_id").select("keep", "quality").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


def test_quality_of_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(5, 1), (10, 1), (12, 0), (13, 0), (None, 1), (1, None)], "doc_id long, quality int")
    clash = docs.withColumn("keep", F.lit("x")).withColumn("n", F.lit(1)).withColumn("p", F.lit(2)).withColumn("host", F.lit(3))
    got = classify(clash, labels)
    assert got.count() == docs.count() and got.where("quality_score is null or keep is null").count() == 0
    assert classify(docs, labels.limit(0)).where("not keep").count() == 0  # nothing is known, nothing is rejected
    assert classify(none, labels).count() == 0
    assert keep_good(clash, labels).columns == clash.columns


def test_sparse_sites_shrink_towards_their_host(spark):
    from tabularium.llm.quality import site_priors

    rows = [("a", f"p{i % 5}", 0.9) for i in range(500)] + [("b", "q", 0.1) for _ in range(500)] + [("c", "r", 0.1), ("a", "new", 0.1)]
    prior = {(r["host"], r["path"]): r["path_prior"] for r in site_priors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert prior["a", "p0"] > 0.8 and prior["b", "q"] < 0.2
    assert prior["c", "r"] > prior["b", "q"] and prior["a", "new"] > 0.5


# 7: pieces


def test_pieces(docs, none):
    plain = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = encode_pieces(docs.withColumn("lossless", F.lit("clash")), MODEL, dropout=0.0).select("text", "piece_ids", "lossless").collect()
    assert all(r["lossless"] and list(r["piece_ids"]) == (plain.encode(r["text"]) if r["text"] else []) for r in got)
    varied = encode_pieces(docs, MODEL, dropout=0.3, seed=5)
    again = {(r["doc_id"], r["text"]): r["piece_ids"] for r in encode_pieces(docs.repartition(2), MODEL, dropout=0.3, seed=5).collect()}
    back = decode_pieces(varied, MODEL).collect()
    assert all(r["decoded"] == (r["text"] or "") and r["lossless"] and r["piece_ids"] == again[r["doc_id"], r["text"]] for r in back)
    long = next(r for r in back if r["text"] and len(r["text"]) > 9000)
    assert list(long["piece_ids"]) != plain.encode(long["text"])
    assert encode_pieces(none, MODEL).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])), st.integers(0, 9))
def test_any_text_decodes(text, seed):
    pieces = test_any_text_decodes.__dict__.setdefault("pieces", Pieces(*model_state(MODEL)))
    for cache in (*pieces.cache, *pieces.words):
        cache.clear()
    for sample in (text, text + "▁" + text, f" {text}\n"):
        assert pieces.decode(pieces.encode(sample, 0.4, seed)) == sample


@settings(max_examples=100, deadline=None)
@given(st.text("abehtinor▁x ", min_size=1, max_size=60), st.integers(0, 2**32 - 1), st.sampled_from([0, 2**29, 2**31]))
def test_both_agendas_agree(chunk, mark, limit):
    pieces = test_both_agendas_agree.__dict__.setdefault("pieces", Pieces(*model_state(MODEL)))
    draws = [(i * 2654435761 + 12345) % 2**32 for i in range(2**16)]
    assert pieces._merge_short(chunk, mark, limit, draws) == pieces._merge_long(chunk, mark, limit, draws)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abehtinor▁x ü漢", min_size=1, max_size=48), min_size=1, max_size=40), st.integers(0, 2**32 - 1), st.sampled_from([0, 2**29, 2**31]))
def test_chunks_merged_together_are_those_merged_alone(chunks, mark, limit):
    pieces = test_chunks_merged_together_are_those_merged_alone.__dict__.setdefault("pieces", Pieces(*model_state(MODEL)))
    marks = [mark + i for i in range(len(chunks))]
    draws: list[list[int]] = [[] for _ in chunks]
    alone = [pieces.merge(c, m, limit, d) for c, m, d in zip(chunks, marks, draws)]
    first = np.array([int(_gap(m, 0, _scale(limit))) if limit else 2**62 for m in marks])
    ids, totals = pieces.merge_many(chunks, np.array(marks, np.uint64), first, limit)
    assert ids == alone and totals == [d[0] if len(d) == 1 else -1 for d in draws]


def test_each_occurrence_is_cut_anew():
    pieces = Pieces(*model_state(MODEL))
    word, n, share, rng = "international", 20_000, 0.3, random.Random(3)

    def brute() -> tuple[str, ...]:
        part, skipped = list("▁" + word), set()
        while True:
            best = min(((pieces.ranks[a + b], i) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in pieces.ranks and (i, a, b, len(part)) not in skipped), default=None)
            if best is None:
                return tuple(part)
            i = best[1]
            if rng.random() < share:
                skipped.add((i, part[i], part[i + 1], len(part)))
                continue
            old, at = len(part), i
            part[i : i + 2] = [part[i] + part[i + 1]]
            skipped = {(j - (j > at), a, b, old - 1) for j, a, b, _ in skipped if j not in (at - 1, at, at + 1)}

    ids = pieces.encode(" ".join([word] * n), share, 1)
    cuts: dict[tuple, int] = {}
    for i in np.split(ids, np.flatnonzero([pieces.bytes[x].startswith(b" ") for x in ids.tolist()])[1:]):
        text = tuple(pieces.bytes[x].decode().replace(" ", "▁") for x in i.tolist())
        cuts[text] = cuts.get(text, 0) + 1
    expected: dict[tuple, int] = {}
    for _ in range(n):
        cut = brute()
        expected[cut] = expected.get(cut, 0) + 1
    assert len(cuts) > 500 and sum(cuts.values()) == n
    common = [x for x, count in expected.items() if count > 100]
    assert len(common) > 10 and all(abs(cuts.get(x, 0) - expected[x]) < 6 * (2 * expected[x]) ** 0.5 for x in common)
    text = " ".join([word] * 2000)
    starts = Pieces(*model_state(MODEL)).encode(text, share, 1)  # with an empty memory
    assert starts.tolist() == pieces.encode(text, share, 1).tolist() != pieces.encode(text, share, 2).tolist()
    lengths = [len(pieces.decode(x)) for x in (starts, pieces.encode(text + " ", share, 1))]
    assert lengths == [len(text), len(text) + 1]


@settings(max_examples=100, deadline=None)
@given(st.text("abehtinor▁x ", min_size=1, max_size=60), st.integers(0, 2**64 - 1), st.sampled_from([0.1, 0.5, 1.0]))
def test_remembered_results_are_those_of_the_merges(chunk, mark, dropout):
    pieces = test_remembered_results_are_those_of_the_merges.__dict__.setdefault("pieces", Pieces(*model_state(MODEL)))
    limit = int(dropout * 2**32)
    scale = 0.0 if dropout == 1 else 1 / np.log1p(-dropout)
    short, long = [], []
    assert pieces._merge_short(chunk, mark, limit, short) == pieces._merge_long(chunk, mark, limit, long) and short == long
    for _ in range(2):
        assert pieces._remembered(pieces.cache[0], chunk, chunk, mark, limit, scale) == pieces.merge(chunk, mark, limit, [])


# 8: pseudonyms

KEY = b"k" * 32


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.binary(min_size=8, max_size=16))
def test_feistel_is_a_permutation(size, secret):
    size = min(size, 400)
    assert sorted(permute(x, size, secret, "t") for x in range(size)) == list(range(size))


def test_pseudonyms_keep_their_format():
    text = (
        "mail bob.42@mail8.example.com or call +1 (386) 555-3733 from 61.131.143.218, card 4111 1111 1111 1111, born 2001-02-28, 28.02.2001 "
        "and February 28, 2001; iban GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, ip 2001:db8::1, password=c1f6c02f845bf3028d"
    )
    new, kinds = pseudonymise(text, KEY)
    assert kinds == ["email", "phone", "ip", "card", "date", "date", "date", "iban", "ssn", "ip", "secret"]
    for value in ("bob.42", "386", "61.131", "4111 1111", "2001-02-28", "February 28", "WEST", "123-45", "2001:db8::1", "c1f6c02f"):
        assert value not in new
    card = re.search(r"card ([\d ]{19})", new)[1]
    assert pii._luhn(card.replace(" ", "")[:-1]) == int(card[-1])
    days = [dt.date.fromisoformat(re.search(r"born (\S{10})", new)[1]), dt.datetime.strptime(re.search(r", (\d\d\.\d\d\.\d{4})", new)[1], "%d.%m.%Y").date()]
    assert days[0] == days[1] == dt.datetime.strptime(re.search(r"and (\w+ \d+, \d+);", new)[1], "%B %d, %Y").date()
    iban = re.search(r"iban (.*?),", new)[1].replace(" ", "")
    assert pii._mod97(iban[4:] + iban[:4]) == 1
    unassigned = "+1 (017) 555-7713"
    assert pseudonymise(unassigned, KEY)[1] == ["phone"] and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", pseudonymise(unassigned, KEY)[0])
    assert pseudonymise(text, KEY) == (new, kinds) and pseudonymise(text, b"z" * 32)[0] != new


@pytest.mark.parametrize("text,form", [
    ("2024-03-05", r"(?P<Y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)"), ("2024/3/5", r"(?P<Y>\d{4})/(?P<m>\d\d?)/(?P<d>\d\d?)"), ("2024.03.05", r"(?P<Y>\d{4})\.(?P<m>\d\d)\.(?P<d>\d\d)"),
    ("3/5/2024", r"(?P<m>[1-9]\d?)/(?P<d>[1-9]\d?)/(?P<Y>\d{4})"), ("5.3.2024", r"(?P<d>[1-9]\d?)\.(?P<m>[1-9]\d?)\.(?P<Y>\d{4})"),
    ("03/05/24", r"(?P<m>\d\d)/(?P<d>\d\d)/(?P<y>\d\d)"), ("5.3.24", r"(?P<d>[1-9]\d?)\.(?P<m>[1-9]\d?)\.(?P<y>\d\d)"), ("3-5-24", r"(?P<m>[1-9]\d?)-(?P<d>[1-9]\d?)-(?P<y>\d\d)"),
    ("Mar 5, 2024", r"(?P<b>[A-Z][a-z]{2}) (?P<d>\d\d?), (?P<Y>\d{4})"), ("5 Mar 2024", r"(?P<d>\d\d?) (?P<b>[A-Z][a-z]{2}) (?P<Y>\d{4})"),
    ("March 5 2024", r"(?P<b>[A-Z][a-z]+) (?P<d>\d\d?) (?P<Y>\d{4})"), ("March 5th, 2024", r"(?P<b>[A-Z][a-z]+) (?P<d>\d\d?)(?:st|nd|rd|th), (?P<Y>\d{4})"),
    ("5th of March, 2024", r"(?P<d>\d\d?)(?:st|nd|rd|th) of (?P<b>[A-Z][a-z]+), (?P<Y>\d{4})"), ("MAR. 05, 2024", r"(?P<b>[A-Z]{3})\. (?P<d>\d\d), (?P<Y>\d{4})"),
    ("5-Mar-24", r"(?P<d>\d\d?)-(?P<b>[A-Z][a-z]{2})-(?P<y>\d\d)"), ("March 5, '24", r"(?P<b>[A-Z][a-z]+) (?P<d>\d\d?), '(?P<y>\d\d)"), ("5 march 24", r"(?P<d>\d\d?) (?P<b>[a-z]+) (?P<y>\d\d)"),
    ("March 5,\n2024", r"(?P<b>[A-Z][a-z]+) (?P<d>\d\d?),\n(?P<Y>\d{4})"),
])
def test_a_date_has_one_pseudonym_in_every_form(text, form):
    new, kinds = pseudonymise(f"on {text}, they said", KEY)
    assert kinds == ["date"]
    m = re.fullmatch(f"on {form}, they said", new)
    assert m, new
    part = m.groupdict()
    month = int(part["m"]) if "m" in part else [x[:3] for x in pii.MONTHS].index(part["b"][:3].title()) + 1
    year = int(part["Y"]) if "Y" in part else int(part["y"]) + (2000 if int(part["y"]) < 69 else 1900)
    assert dt.date(year, month, int(part["d"])) == pii._day(dt.date(2024, 3, 5), KEY) != dt.date(2024, 3, 5)


def test_days_have_different_pseudonyms():
    days = range(dt.date(1965, 1, 1).toordinal(), dt.date(1973, 1, 1).toordinal())
    new = [pii._day(dt.date.fromordinal(x), KEY) for x in days]
    assert len(set(new)) == len(days) and all((1969 <= x.year < 2069) == (dt.date.fromordinal(d).year >= 1969) and 1800 <= x.year < 2200 for d, x in zip(days, new))
    for text in ("version v1.2.24 of 1.2.3.4.5", "13/13/2024 and 31.02.24", "5 March 10:30", "may 5 10 people", "chapter 3-4-5"):
        assert "date" not in pseudonymise(text, KEY)[1]


def test_what_is_not_personal_stays():
    for text in ("4111 1111 1111 1112", "version 1.2.3", "in 2024 there were 123456 of 7890", "a 999.1.1.1 b", "2001-02-30", "token of thanks", "000-12-3456", "12:30:45"):
        assert pseudonymise(text, KEY) == (text, [])


def test_pseudonyms_link_documents(spark, docs, none):
    rows = [(1, "call +1 (386) 555-3733 now", "a"), (2, "x +1 (386) 555-3733", "b"), (2, None, "c"), (None, "", "d"), (4, "y +1 (386) 555-3734", "e")]
    got = pseudonyms(spark.createDataFrame(rows, "doc_id long, text string, pii_kinds string"), "secret").collect()
    found = {r["doc_id"]: r["text"] for r in got if r["text"]}
    number = {i: re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", t)[0] for i, t in found.items()}
    assert number[1] == number[2] != number[4] and number[1] != "+1 (386) 555-3733"
    assert sorted((r["text"] is None, len(r["pii_kinds"])) for r in got) == [(False, 0), (False, 1), (False, 1), (False, 1), (True, 0)]
    assert rows_of(pseudonyms(docs, "s").select("doc_id", "text")) == sorted(((r[0], r[1]) for r in awkward()), key=key)
    assert pseudonyms(none, "s").count() == 0


# 9: decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(rows, items):
    windows = {}
    for item, text in items:
        w = lowered(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for i, text, *_ in rows:
        w, hit, found = lowered(text), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in windows:
                    hit |= set(range(a, a + size))
                    found |= windows[tuple(w[a : a + size])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=key)


def test_contamination(spark, docs, none):
    rng = random.Random(9)
    passage = words(rng, 40).split()
    line = "a common line of seven small words"
    items = [(1, " ".join(passage)), (2, " ".join(passage[5:30]) + " " + line), (10, line), (3, "alpha beta"), (4, "gamma"), (5, ""), (6, None), (None, "delta eps zeta"),
             (7, "rep " * 15), (1, "second text of one"), (8, awkward()[5][1][:200])]
    rows = awkward() + [(100 + i, t, None, None, None) for i, t in enumerate([
        " ".join(passage[3:22]), "X " * 300 + " ".join(passage[10:23]), " ".join(passage[:12]), f"{line}! {line}? {line}", "Alpha, BETA gamma", "alpha x beta", "rep " * 14,
        "rep " * 12, "delta eps zeta", " ".join(passage[:20] + ["cut"] + passage[20:]), "é1 É1 gammaé", ("q " * 20 + line + " ") * 50,
    ])]
    table = spark.createDataFrame(items, "item_id int, text string")
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(contamination(frame, table)) == contaminated(rows, items)
    assert rows_of(contamination(docs, table.limit(0))) == contaminated(awkward(), [])
    assert contamination(none, table).count() == 0
    kept = without_contaminated(frame, table)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in contaminated(rows, items) if not r[5]), key=str)


def test_decontamination_plan_is_native(spark, docs):
    items = spark.createDataFrame([(1, "a b c d")], "item_id int, text string")
    plan = contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# 10: licences


def test_license_matches(spark, docs, none):
    rows = [
        (1, "text\nReleased under the MIT License.\nmore\nLicensed under CC BY-NC 4.0."), (2, "Licensed under the Apache License, version 2.0"),
        (3, "released under the mit licence, they say"), (None, "Licensed under CC BY 4.0."), (5, None), (5, ""), (6, "License"),
        (7, "Permission to use, copy, modify, and/or distribute this software\nfor any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice\nappear in all copies.\n\nother text"),
        (8, "Permission to use, copy, modify, and/or distribute this software\nfor any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice\nappear in all copies.\n\n" + " ".join(f"w{i}" for i in range(90))),
    ]
    got = {(r["doc_id"], r["license"]): (r["n_lines"], r["n_paragraphs"], r["whole_text"], r["best_dice"]) for r in license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "MIT"][0] == 1 and got[1, "CC-BY-NC-4.0"] == (1, 0, False, 1.0)
    assert got[2, "Apache-2.0"] == (1, 0, True, 1.0) and got[None, "CC-BY-4.0"][3] == 1.0
    assert got[7, "ISC"] == (0, 1, True, 1.0) and got[8, "ISC"] == (0, 1, False, 1.0)
    assert set(got) == {(8, "ISC"), (1, "MIT"), (1, "CC-BY-NC-4.0"), (2, "Apache-2.0"), (None, "CC-BY-4.0"), (7, "ISC")}
    assert license_matches(docs).count() == 0 and license_matches(none).count() == 0 and license_matches(docs, {}).count() == 0
    plan = license_matches(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)

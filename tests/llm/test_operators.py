"""Operators on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import time

import brute
import pytest
from pyspark.sql import functions as F

from lanternflow.llm import (common, decontaminate, langid, lexicon, licenses, linededup, mainhtml, minhash, queries, simhash,
                             tokenfiles, urlfilter)

DOCS = "doc_id long, text string"
ODD = ["", None, "   ", "\n\n", "Ünï çödé Ǆ ﬁ İ Σας É\u0301", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x1fz", "don't.. stop_. 3,4. ___", "\U0001F600 \u200b é.\n, ."]


def prose(seed, n, alphabet="abcdefgh"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 300)
    words = base.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    out = [base, base, near, prose(2, 300), prose(3, 20_000), "one two three", "one two three", *ODD]
    return [(i * 100 + 7, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def clashing(df):
    """The same rows with columns that operators use inside or return."""
    for c in ("n_words", "host", "rule", "_c", "_w", "lines_removed", "score", "key", "sig", "n", "licenses", "b", "hash"):
        df = df.withColumn(c, F.lit("x"))
    return df


def test_components_equal_brute_force(docs, rows):
    for percent in (80, 85):
        found = by_id(minhash.near_duplicates(clashing(docs), percent), "n_shingles", "component_id")
        assert found == brute.components(rows, percent)
    assert found[107][1] == found[207][1] == 7 and found[607][1] == 507


def test_hub_and_chain_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_estimate_follows_the_similarity():
    a, b = minhash._permutations(800)
    hashes = minhash._hash_memo()
    words = [str(i).encode() for i in range(600)]
    x, y = minhash.shingle_set(words[:500], 1, hashes), minhash.shingle_set(words[100:], 1, hashes)
    sig = lambda s: minhash.np.frombuffer(minhash.low_bits(s, a, b), minhash.np.uint8)[None]
    assert abs(minhash.estimate(sig(x), sig(y))[0, 0] - 400 / 600) < 0.07


def test_exact_links_of_many_sets():
    rng = random.Random(5)
    sets = [set(rng.sample(range(60), 45)) for _ in range(30)]
    arrays = [minhash.np.array(sorted(s), minhash.np.uint64) for s in sets]
    want = {(p, q) for q in range(30) for p in range(q) if 100 * len(sets[p] & sets[q]) >= 70 * len(sets[p] | sets[q])}
    label = lambda edges: {v: min(u for u in range(30) if u in _reach(v, edges)) for v in range(30)}
    got = set(minhash.exact_links(arrays, 70))
    assert got <= want and label(got) == label(want)


def _reach(v, edges):
    seen, todo = {v}, [v]
    while todo:
        u = todo.pop()
        for a, b in edges:
            for w in ({a, b} - {u} if u in (a, b) else ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
    return seen


def test_fingerprints_and_edited_texts(docs, rows):
    found = by_id(simhash.edited_fingerprints(clashing(docs), 4), "n_chars", "edited_sha256", "fingerprint", "near_edited")
    assert {k: v[1] for k, v in found.items()} == brute.edited(rows)
    assert all(found[i][0] == len(t or "") for i, t in rows)
    assert found[7][2] == found[107][2] and 0.5 < found[407][3] < 1
    assert by_id(simhash.fingerprints(docs), "fingerprint") == {k: (v[2],) for k, v in found.items()}


@pytest.mark.parametrize("radius,blocks", [(0, 1), (3, 1), (3, 2), (7, 1)])
def test_hamming_search_finds_all(spark, radius, blocks):
    rng = random.Random(radius)
    values = [rng.getrandbits(128) for _ in range(20)]
    values += [v ^ sum(1 << b for b in rng.sample(range(128), k)) for v in values[:10] for k in (1, 3, 5, 8)]
    table = spark.createDataFrame([(f"{v:032x}",) for v in [*values, values[0]]] + [(None,)], "fingerprint string")
    found = {(r["query"], r["near"], r["distance"]) for r in simhash.near_fingerprints(table, table, radius, blocks).collect()}
    assert found == {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in values for b in values if (a ^ b).bit_count() <= radius}


def test_url_rules_equal_brute_force(spark):
    urls = ["http://a.example.net/en/x", "http://example.net/de", "HTTP://Example.NET/en/", "http://notexample.net/en/", "net/", None, "", "://", "x://net",
            "http://a.b.example.com/de/1?q", "http://fr.org/fr/", "http://org/fr", "http://org.com/fr/", "ftp://X.org/fr/a#b", "http://example.com:80/de/",
            "http://example.net/en/a/b/c", "http://b://c.net/", "http://é.net/\n/x", "http://example.net./en/"] * 2
    rules = [*queries.URL_RULES, ("example.net", "/en/a/", "block"), ("example.net", "/en/a/b", "allow"), ("a.example.net", "/", "block"), ("org", "/fr/", "block")]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("_k", F.lit(2))
    found = urlfilter.judge_urls(table, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=3)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()} == {
        i: brute.judged(u, rules) for i, u in enumerate(urls)}


def test_contamination_equals_brute_force(spark, docs, rows):
    text = rows[0][1].split()
    items = [(1, " ".join(text[40:60])), (2, "ONE two"), (3, None), (4, ""), (5, " ".join(text[100:112])), (6, " ".join(text[45:70])), (7, "no such words here")]
    found = decontaminate.contamination(clashing(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert by_id(found, "n_words", "n_hit", "item_ids") == brute.contaminated(rows, items)
    near = decontaminate.proximity_matches(docs, spark.createDataFrame([(9, " ".join([*text[49:44:-1], *text[52:57]]))], "item_id long, text string"), slop=2)
    assert {r["doc_id"] for r in near.collect()} >= {7, 107}


def test_contamination_with_sigmas(spark):
    passages = ["Α.Σ. Β γ δ ε ζ η θ ι κ λ μ", "ΟΔΟΣ'Α β γ δ ε ζ η θ ι κ λ", "one Σ two ΑΣ three four five six seven eight nine"]
    rows = [(i, f"before it {p} after it") for i, p in enumerate(passages)] + [(9, "none of it")]
    items = list(enumerate(passages))
    found = by_id(decontaminate.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), rarest=10),
                  "n_words", "n_hit", "item_ids")
    assert found == brute.contaminated(rows, items) and all(found[i][2] == [str(i)] for i in range(3))


def test_contamination_cuts_a_text_once(spark):
    """Cut anew for each of its 15,000 candidates, the long text took minutes."""
    text = "a b " * 15_000
    docs, items = spark.createDataFrame([(1, text), (2, "a c b")], DOCS), spark.createDataFrame([(5, "a b"), (6, "b c")], "item_id long, text string")
    began = time.monotonic()
    found = by_id(decontaminate.contamination(docs, items), "n_words", "n_hit", "item_ids")
    near = {(r["doc_id"], *r["items"]) for r in decontaminate.proximity_matches(docs, items).collect()}
    assert time.monotonic() - began < 60
    assert found == {1: (30_000, 30_000, ["5"]), 2: (3, 0, [])} and near == {(1, 5), (2, 5), (2, 6)}


def test_words_of_odd_texts(spark):
    every = "".join(map(chr, range(128)))
    texts = [*ODD, every, every[::-1], "".join(f"x{c}y{c}{c}" for c in every), " a ", "a", ".", "--a--", "\x7f\x80\U0010ffffZ{", "K\u212aÅ\u212b[`İ@"]
    cut = spark.createDataFrame(list(enumerate(texts)), DOCS).select("doc_id", decontaminate.words_of(F.col("text")).alias("w"))
    assert {r["doc_id"]: r["w"] for r in cut.collect()} == {i: brute.WORD.findall(brute.ascii_lower(t)) for i, t in enumerate(texts)}


def test_line_chunks_are_removed_after_the_first(spark):
    a, b = [f"line {i} {prose(i, 6)}" for i in range(30)], [f"other {i} {prose(50 + i, 6)}" for i in range(9)]
    long = prose(99, 60)
    texts = ["\n".join(a), "\n".join([*b[:4], *a, *b[4:]]), "\n".join([b[0], long]), "\n".join([long, "end"]), "short\nlines", "short\nlines", None, "", "\n".join(a)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("lines_removed", F.lit("x")).withColumn("marks_", F.lit(1))
    found = by_id(linededup.dedup_lines(df), "text", "lines_removed")
    assert found[0] == (texts[0], 0) and found[4] == found[5] == ("short\nlines", 0) and found[6] == (None, 0) and found[7] == ("", 0)
    assert found[2] == (texts[2], 0) and found[3] == ("end", 1)
    left = found[1][0].split("\n")
    assert found[1][1] >= 20 and set(b) <= set(left) and len(left) + found[1][1] == 39
    assert found[8][1] >= 28


@pytest.mark.parametrize("lines,words", [(5, 12), (3, 40), (4, 13), (2, 26), (7, 8)])
def test_short_runs_of_fifty_words_are_removed(spark, lines, words):
    texts, want = [], {}
    for seed in range(12):
        passage = [prose(1000 * seed + i, words) for i in range(lines)]
        if seed % 3 == 0:
            passage = [prose(9000 + seed, 60), "short line", *passage[:-1], "", passage[-1]]
        for copy in range(2):
            around = [[prose(7 * (100 * seed + 10 * copy + i) + 5, 9) for i in range(4)] for _ in range(2)]
            around[1] = [x + " z" for x in around[1]]
            texts.append("\n".join([*around[0], *passage, *around[1]]))
            want[len(texts) - 1] = ("\n".join([*around[0], *around[1]]), len(passage)) if copy else (texts[-1], 0)
    assert by_id(linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), DOCS)), "text", "lines_removed") == want


def test_overlapping_repeats_leave_the_first(spark):
    line = prose(3, 20)
    texts = ["\n".join([line] * 7), "\n".join(["", "", prose(4, 30), "", prose(5, 30), ""]), "\n".join([prose(4, 30), "", prose(5, 30), "", ""])]
    found = by_id(linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), DOCS)), "text", "lines_removed")
    assert found == {0: ("\n".join([line] * 3), 4), 1: (texts[1], 0), 2: ("", 5)}


def test_spans_cover_every_shared_run():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice([0, 1, 7, 20, 60]) for _ in range(rng.randint(1, 25))]
        spans = linededup.passage_spans(words, 50)
        assert all(sum(words[a:b]) >= 50 and words[a] and words[b - 1] for a, b in spans)
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                if sum(words[a:b]) >= 50:
                    inside = {i for c, d in spans if a <= c and d <= b for i in range(c, d)}
                    assert {i for i in range(a, b) if words[i]} <= inside


def test_chunks_cover_all_lines():
    for seed in range(20):
        text = "\n".join(prose(seed * 50 + i, random.Random(i * seed).choice([0, 1, 5, 60])) for i in range(25))
        chunks = linededup.line_chunks(text)
        assert [c[0] for c in chunks] == [0, *[c[1] for c in chunks[:-1]]] and chunks[-1][1] == 25
        assert all(b - a == 1 for a, b, long in chunks if long)


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path())


def test_token_files_round_trip(spark, docs, rows):
    found = by_id(tokenfiles.token_file_digest(clashing(docs), queries.tokenizer_path()), "start", "n_tokens", "ids_crc32")
    assert found == brute.token_digest(rows, library())
    record = tokenfiles.frame(b"payload")
    assert tokenfiles.unframe(record) == b"payload"
    for i in range(len(record)):
        with pytest.raises(ValueError):
            tokenfiles.unframe(record[:i] + bytes([record[i] ^ 1]) + record[i + 1:])


def test_bpe_equals_the_library(docs, rows):
    t = library()
    found = by_id(lexicon.encode_decode(clashing(docs), queries.tokenizer_path(), words=50), "n_tokens", "ids", "decoded")
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert found[i] == (len(ids), ids, t.decode(ids, skip_special_tokens=False))


def test_automaton_shares_suffixes_and_ranks_words():
    words = sorted({w.encode() for w in re.findall(r"\w+", prose(8, 3000))} | {b"a", b"ab", b"abc", b"zabc", "é".encode()})
    lex = lexicon.Lexicon(lexicon.Lexicon.compile({w: [i, i + 1] for i, w in enumerate(words)}))
    assert lex.ranks(words).tolist() == list(range(len(words))) and lex.ids_of(3) == [3, 4]
    missing = [w + b"#" for w in words[:50]] + [b"", b"#"]
    assert set(lex.ranks(missing).tolist()) == {-1}
    assert len(lex.final) < sum(map(len, words)) / 3
    assert lexicon.Lexicon(lexicon.Lexicon.compile({})).ranks([b"x"]).tolist() == [-1]


def test_languages_by_family(spark):
    rng = random.Random(4)
    stock = {"en": "the of and with house", "de": "der und nicht über haus", "fr": "le être dans avec maison", "es": "el niño para con casa"}
    rows = [(i, " ".join(rng.choices(stock[lang].split(), k=12)), lang) for i, lang in enumerate([*stock] * 40)]
    rows += [(900, None, "en"), (901, "123 --", "de"), (902, "le être dans", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    found = by_id(langid.identify(df, langid.fit_languages(df.filter("doc_id % 3 = 0"))), "lang_pred", "score")
    assert all(found[i][0] == lang for i, _, lang in rows[:160]) and found[902][0] == "fr"
    assert found[900] == found[901] == ("und", 0.0) and all(0 <= v[1] <= 1 for v in found.values())
    nobody = langid.fit_languages(df.filter("doc_id < 0"))
    assert by_id(langid.identify(df.limit(1), nobody), "lang_pred", "score") == {rows[0][0]: ("und", 0.0)}


ARTICLE = "First sentence of the story, with some length &amp; weight. It goes on, and on; then it stops."


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<html><nav><a>Home</a></nav></html>", ""),
    (f"<html><body><header><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav><article><h1>Story</h1><p>{ARTICLE}<p>A <b>bold</b>\n end.</article>"
     "<div class='ad'>Buy now, cheap, cheap!</div><div id=comments><p>I liked it, a lot, really.</p></div><footer>&copy; Site.</footer><script>var p='</p>';</script></body></html>",
     "Story First sentence of the story, with some length & weight. It goes on, and on; then it stops. A bold end."),
    (f"<div class=menu>a b c</div><div class='post'><div><p>{ARTICLE}</p><p>Short.</p></div><form>Name, please.</form></div>",
     "First sentence of the story, with some length & weight. It goes on, and on; then it stops. Short."),
])
def test_main_text(page, text):
    assert mainhtml.main_text(page) == text


LONG = "A long part of the story, with many words, goes on here. " * 12


@pytest.mark.parametrize("page,text", [
    (f"<article><h1>Title</h1><p>Intro.</p><div class=body><p>{LONG}</p></div><p>End.</p></article>", f"Title Intro. {LONG}End."),
    (f"<body><div><a>Top</a></div><div class=post><h1>Title</h1><p>Intro.</p><div class=body><p>{LONG}</p></div><p>End.</p></div></body>", f"Title Intro. {LONG}End."),
    (f"<article><p>Before.</p><ul><li>{LONG}<li>{LONG}</ul><p>After.</p></article>", f"Before. {LONG}{LONG}After."),
    (f"<div><p>Before.</p><blockquote><p>{LONG}</p></blockquote><p>After.</p></div>", f"Before. {LONG}After."),
    (f"<main><div><p>Lead.</p></div><div><article><p>Begin.</p><p>{LONG}</p><p>End.</p></article></div></main>", f"Lead. Begin. {LONG}End."),
    (f"<article><p>{LONG}</p><section id=discussion><h2 id='search-methods'>Methods</h2><p class='notice-of-terms'>Terms.</p></section>"
     "<section id='related-work'><h2 id=social-effects>Effects</h2><p id=share>Work.</p></section></article>", f"{LONG}Methods Terms. Effects Work."),
    (f"<div class='post with-sidebar'><p>{LONG}</p></div><div class='related-posts'><p>{ARTICLE}</p></div><div id=main-nav>Home</div>", LONG.strip()),
    (f"<div class='entry has-comments tags-news'><p>{LONG}</p></div><div class='comment-list'><p>{LONG}{LONG}</p></div>", LONG.strip()),
    (f"<div class=widget><p>{LONG}</p></div>", LONG.strip()),
    (f"<article><p>{LONG}<math><mi>x</mi></math> <object>fallback</object></p><noscript><p>Plain.</p></noscript></article>", f"{LONG}x fallback Plain."),
])
def test_main_text_is_whole(page, text):
    assert mainhtml.main_text(page) == text


def test_licenses_by_compression(spark):
    texts = ["Some prose.\nReleased under the MIT License.\nMore prose.", "This work is licensed under the GNU General Public License, version 2.",
             "Licensed under the Apache License, Version 2.0.", "I lost my driving license yesterday, near the public library.", None, "", "All rights reserved."]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(clashing(spark.createDataFrame(list(enumerate(texts)), DOCS))).collect()}
    assert [found[i]["licenses"] for i in range(7)] == [["MIT"], ["GPL-2.0"], ["Apache-2.0"], [], [], [], ["Proprietary"]]
    assert found[3]["n_blocks"] == 1 and found[4]["n_blocks"] == 0
    saved, diff = licenses.wording_differences("Released under the very MIT License", "Released under the MIT License.")
    assert saved == 1 and diff == ["+very"]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("width", [40, 80])
def test_wrapped_standard_notices_are_found(mark, width):
    import textwrap
    for name, wordings in licenses.TEMPLATES.items():
        for wording in wordings:
            lines = "\n".join(mark + x for x in textwrap.wrap(wording, width))
            for text in (lines, f"Some words before it.\n\n{lines}\n\nSome words after it."):
                assert {x["license"] for x in licenses.scan_text(text)[1]} == {name}, (name, wording)


def test_every_license_of_a_block_is_found():
    gpl, mit = licenses.TEMPLATES["GPL-3.0"][-1], licenses.TEMPLATES["MIT"][-1]
    found = licenses.scan_text(f"Licensed under CC BY-NC 4.0. Released under the MIT License. Copyright. All rights reserved.\n{gpl}\n{mit}")[1]
    assert [x["license"] for x in found] == ["CC-BY-NC-4.0", "MIT", "Proprietary", "GPL-3.0", "MIT"] and not any(x["differences"] for x in found)
    assert licenses.scan_text("He reserved all the rooms. All of the rights were his, and copyright law is dull.")[1] == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    path = queries.tokenizer_path()
    for df in (minhash.near_duplicates(none), simhash.edited_fingerprints(none, 2), linededup.dedup_lines(none), lexicon.encoding_digest(none, path),
               tokenfiles.token_file_digest(none, path), licenses.scan_licenses(none),
               decontaminate.contamination(none, spark.createDataFrame([], "item_id long, text string")),
               mainhtml.extract_main_text(spark.createDataFrame([], "page_id long, html string")),
               urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([("a", "/", "block")], "host string, path string, verdict string"))):
        assert df.count() == 0


def test_pipeline_keeps_clean_documents(spark, sf):
    import corpus_pipeline
    docs = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = common.durable(out)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in common.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert not any(v[1] for v in brute.contaminated(texts.items(), items).values())
    t = library()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    digest = lambda text: hashlib.sha256(" ".join(map(str, t.encode(text, add_special_tokens=False).ids)).encode()).hexdigest()
    assert by_id(last, "ids_sha256") == {i: (digest(x),) for i, x in texts.items()}

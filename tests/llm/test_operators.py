"""Every operator against brute force, an exact round trip, or held-out accuracy."""
import hashlib
import math
import os
import pathlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glazier.llm import (common, components, embedding_dedup, fingerprints, html_extraction, lattice, mixing, ngram_join,
                         packing, queries, sharding, shingles, token_counts, toxicity)

SF = "/root/testdata/sf0.001"


def table(spark, name, folder=SF):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, "documents").collect()}


# --- 8 sharding -------------------------------------------------------------------------------

def jump(key, shards):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < shards:
        b, key = j, (key * sharding.LCG + 1) & (2**64 - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_function(spark):
    keys = [0, 1, -1, 10863919174838991, 2**63 - 1, -2**63, *range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 64):
        assert [r[0] for r in df.select(sharding.jump_hash(F.col("k"), n)).collect()] == [jump(k, n) for k in keys]


def test_appending_a_shard_moves_rows_into_it_only(spark, texts):
    rows = queries.QUERIES["op8_jump_sharding"](spark, SF).collect()
    assert all(r.shard == jump(r.doc_id, 8) and r.grown_shard == jump(r.doc_id, 9) for r in rows)
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 for r in rows)


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = table(spark, "documents")
    path = sharding.write_shards(docs, str(tmp_path / "shards"), "doc_id", 8)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and {r[0] for r in back.select("shard").distinct().collect()} <= set(range(8))


# --- 7 fingerprints ---------------------------------------------------------------------------

def test_fingerprints_and_edits(spark, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["op7_imatch_fingerprints"](spark, SF).collect()}
    ids = sorted(texts, reverse=True)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        k = len(texts[a]) // 3
        edited = texts[a][:len(texts[a]) - k] + texts[b][:k]
        assert rows[a].n_chars == len(texts[a]) and rows[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        same = [(x, y) for x, y in zip(rows[a].fingerprint.split("."), rows[b].fingerprint.split(".")) if x or y]
        assert rows[a].near_next == pytest.approx(sum(x == y for x, y in same) / len(same) if same else 0)
    by_text = defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(rows[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    near = np.array([[r.near_edited, r.near_next] for r in rows.values()])
    assert (near[:, 0] >= near[:, 1]).mean() > 0.97 and near[:, 0].mean() > 10 * near[:, 1].mean()


def test_lexicon_is_the_idf_band(spark):
    docs = spark.createDataFrame([(i, " ".join(["all"] + ["half"] * (i % 2) + (["few"] if i < 3 else []) + [f"own{i}"]))
                                  for i in range(40)], "doc_id long, text string")
    found = {r.term: r.df for r in fingerprints.lexicon(docs, math.log(2), math.log(20)).collect()}
    hashes = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in ("all", "half", "few")}
    assert hashes["all"] not in found and all(n in (3, 20) for n in found.values())


def test_very_long_texts_have_fields(spark, tmp_path):
    """Copies of texts with 21,000 in-band terms, too many for the fixed rates."""
    long = [" ".join(f"{name}{i}" for i in range(21_000)) for name in "ab"]
    rows = [(9, long[0]), (8, long[0]), (7, long[1]), (6, long[1]), *[(i, f"short text {i}") for i in range(6)]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.QUERIES["op7_imatch_fingerprints"](spark, str(tmp_path)).collect()}
    assert found[9].fingerprint.strip(".") and found[7].fingerprint.strip(".")
    assert found[9].fingerprint == found[8].fingerprint != found[7].fingerprint
    assert found[9].near_next == found[7].near_next == 1 and found[8].near_next == 0
    assert 0 < found[9].near_edited <= 1
    assert fingerprints.rates_for(16_384) == fingerprints.RATES and fingerprints.rates_for(10**6)[-1] == 17


# --- 9 packing --------------------------------------------------------------------------------

def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.tokenizer_files()[0])
    pieces = packing.pack_documents(table(spark, "documents"), with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        own = sorted(by_doc[doc_id], key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == ids
        assert all(p.doc_tokens == len(ids) for p in own)
    padding = 0
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert padding < 0.02 * sum(p.length for p in pieces) + packing.CAPACITY


def test_chunked_ids_equal_whole_ids():
    from tokenizers import Tokenizer
    json_file, ranks = packing.tokenizer_files()
    whole, chunked = Tokenizer.from_file(json_file), packing.chunk_ids(json_file, ranks)
    rng = random.Random(3)
    parts = ["word", " ", "  ", "\n", "\n\n ", "don't", "'s", "12.5", "é", "漢字", "😀", "<|endoftext|>", "\t", " ", "​", "x" * 60, ".", "ﬁ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(chunked.text(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_first_fit_decreasing_matches_a_scan():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 65, rng.integers(1, 80))
        sequence, offset = packing.first_fit_decreasing(lengths, 64)
        free, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            if lengths[i] == 64:
                continue
            at = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
            if at == len(free):
                free.append(64)
            want[i] = (at, 64 - free[at])
            free[at] -= lengths[i]
        assert all((sequence[i], offset[i]) == w for i, w in want.items())
        assert len(set(sequence[lengths == 64].tolist()) & set(range(len(free)))) == 0


# --- 6 toxicity -------------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op6_toxic_lexicon"](spark, folder).join(table(spark, "labels", folder), "doc_id")
    rows = scored.filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.98
    assert not [r for r in rows if r.predicted and not r.toxic]


def test_folding_exceptions_and_length():
    lexicon = toxicity.Lexicon({toxicity.fold("idiot"): 5.0}, [toxicity.fold("idiot proof")], 0.1)
    matcher = toxicity.Matcher(lexicon)
    for text in ("an idiot", "an 1D10T", "an іdіоt", "ｉｄｉｏｔ", "idiotic"):
        assert matcher.score(text) > 0.7, text
    for text in ("", "an idiot proof lock", "semidiot", "plain words"):
        assert matcher.score(text) == 0, text
    assert matcher.score("idiot " + "word " * 5000) < 0.1


# --- 3 n-gram join ----------------------------------------------------------------------------

def brute_components(texts, percent=75):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            n, m = len(sets[a]), len(sets[b])
            if n and m and 100 * min(n, m) >= percent * max(n, m):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (n + m - both):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def joined(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_join_equals_brute_force(spark, texts):
    assert joined(queries.QUERIES["op3_set_relation_join"](spark, SF)) == brute_components(texts)


def test_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Pairs near the threshold, a passage in every text, lists of several blocks, leader rounds."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", 4)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    base = [f"b{i}" for i in range(80)]
    made = {}
    for i in range(160):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(80)] = f"e{rng.random()}"
        made[i] = " ".join(words + passage)
    for i in range(160, 260):
        made[i] = " ".join([f"r{rng.randrange(400)}" for _ in range(rng.randint(1, 40))] + passage)
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(4)
    assert joined(ngram_join.jaccard_components(docs)) == brute_components(made)


def test_join_of_few_rows_takes_few_tasks(spark, monkeypatch):
    """With many shuffle partitions and few rows, every stored step is written by tasks sized by its rows."""
    from glazier.llm import common
    folders, path = [], common.shared_path
    monkeypatch.setattr(common, "shared_path", lambda s, name: folders.append(path(s, name)) or folders[-1])
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    made = {i: " ".join([*base[:30], f"e{rng.random()}", *base[31:]]) if i % 3 else " ".join(f"r{rng.random()}" for _ in range(20))
            for i in range(300)}
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert joined(ngram_join.jaccard_components(docs)) == brute_components(made)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = {f: len([x for x in os.listdir(f.removeprefix("file:")) if x.startswith("part-")]) for f in folders}
    assert any("ngram-links" in f for f in files) and any("stars" in f for f in files)
    assert all(n <= 8 for f, n in files.items() if "ngram-sets" not in f), files


def test_index_tells_long_lists(spark, monkeypatch):
    """Lists that end inside, at the end of or over batches, with repeated entries: numbers, lengths, nothing lost."""
    monkeypatch.setattr(ngram_join, "LONG", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    made, tokens = [], {}
    for list_of in range(60):
        phrase = " ".join(f"p{list_of}x{k}" for k in range(5))
        made += [f"{phrase} u{list_of}y{i}" for i in range(list_of % 13 + 1)]
    made += made[::4]
    for text in set(made):
        shingles = ngram_join.shingle_set(text.encode(), 5)
        for at, token in enumerate(shingles[:len(shingles) - -(-75 * len(shingles) // 100) + 1].view("int64").tolist()):
            tokens.setdefault(token, set()).add(((len(shingles) << 32) + at, ngram_join._signature(shingles)[0]))
    expected = {(token, sid, place, k, len(of) >= 3, len(of) > 5) for token, of in tokens.items() if len(of) > 1
                for k, (place, sid) in enumerate(sorted(of))}
    assert {x[4:] for x in expected} == {(False, False), (True, False), (True, True)}
    docs = spark.createDataFrame([(t,) for t in made], "text string").repartition(4)
    none = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    for rows in ("1", "2", "4", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            found = [tuple(r) for r in ngram_join._index(docs, none, 26, 3).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(found) == len(expected) and set(found) == expected, rows


def test_join_holds_the_shuffles_of_one_step(spark, monkeypatch):
    """When the join has ended, the shuffles of its steps are gone, but for those of the small marks."""
    def left():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f.name.split("_")[1] for d in dirs for f in pathlib.Path(d.getPath()).glob("*/shuffle_*.data")}

    marked, mark, before = [], ngram_join._marked, left()
    monkeypatch.setattr(ngram_join, "_marked", lambda wanted: marked.append(1) or mark(wanted))
    base = [f"b{i}" for i in range(60)]
    made = {i: " ".join([*base[:30], f"e{i}", *base[31:]]) for i in range(100)}
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(4)
    conf = spark.conf.get(common.SHUFFLE_CLEANUP, None)
    found = ngram_join.jaccard_components(docs)
    assert spark.conf.get(common.SHUFFLE_CLEANUP, None) == conf
    for _ in range(50):  # executors remove files behind the query's end
        if len(left() - before) <= len(marked):
            break
        time.sleep(0.1)
    assert len(left() - before) <= len(marked)
    assert joined(found) == brute_components(made)


def test_shingle_hashes():
    rng = random.Random(2)
    for _ in range(200):
        words = ["".join(rng.choice("aAbBé ") for _ in range(4)).strip() or "z" for _ in range(rng.randint(0, 30))]
        text = rng.choice([" ", "\n", "\t\x0b  "]).join(words).encode()
        w = bytes(text).lower().split()
        assert len(shingles.word_hashes(text)) == len(w)
        assert len(shingles.shingle_set(text)) == (len({tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))}) if w else 0)
    assert (shingles.shingle_set(b"One two  THREE four five") == shingles.shingle_set(b"one TWO three\nfour five")).all()


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(f"word{i}" for i in range(2000)).encode()
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "_BLOCK", 64)
    assert (shingles.word_hashes(text) == whole).all()


def test_components_of_random_links(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {i: i for p in links for i in p}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {i: find(i) for a, b in links if a != b for i in (a, b)}


# --- 10 embeddings ----------------------------------------------------------------------------

def test_lattice_points():
    rng = np.random.default_rng(0)
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS ** 2).sum(axis=1), 2)
    y = rng.standard_normal((200, 8)) * 2
    p = lattice.nearest_points(y)
    assert all(((2 * r) % 2 == 0).all() and r.sum() % 2 == 0 or ((2 * r) % 2 == 1).all() and r.sum() % 2 == 0 for r in p)
    off = ((y - p) ** 2).sum(axis=1)
    assert (off <= 1 + 1e-9).all()  # covering radius
    around = ((y[:, None] - p[:, None] - lattice.NEIGHBOURS) ** 2).sum(axis=2).min(axis=1)
    assert (off <= around + 1e-9).all()


def brute_links(vectors, labels, threshold=0.93):
    x = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    g = (x @ x.T >= threshold) & (labels[:, None] == labels)
    np.fill_diagonal(g, False)
    return g


def test_embeddings_equal_brute_force(spark):
    rows = sorted(table(spark, "embeddings").collect(), key=lambda r: r.vec_id)
    g = brute_links(np.array([r.embedding for r in rows], float), np.array([r.label for r in rows]))
    found = {r.vec_id: r for r in queries.QUERIES["op10_e8_near_duplicates"](spark, SF).collect()}
    assert [found[r.vec_id].n_links for r in rows] == g.sum(axis=1).tolist()


def test_recall_near_the_threshold(spark):
    """Planted pairs at cosines 0.93 to 0.96, and a dense group whose balls touch."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((600, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal((600, 64))
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(0.9305, 0.96, 600)[:, None]
    group = base[0] + rng.standard_normal((300, 64)) * 0.03
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * side, group])
    labels = np.concatenate([np.arange(600) % 3, np.arange(600) % 3, np.zeros(300)]).astype(int)
    g = brute_links(x, labels)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))],
                               "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    n = np.array([found[i].n_links for i in range(len(x))])
    assert (n <= g.sum(axis=1)).all() and n.sum() >= 0.98 * g.sum()


# --- 5 pages, 2 tokens, 4 mixing ----------------------------------------------------------------

def test_pages_keep_the_article(spark):
    found = {r.page_id: r.text for r in queries.QUERIES["op5_tag_path_ratios"](spark, SF).collect()}
    for page in table(spark, "pages").collect():
        article = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        article = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|div|ul|li)[^>]*>|<br>", " ", article))
        assert found[page.page_id] == " ".join(html_extraction.html_lib.unescape(article).split())


@pytest.mark.parametrize("page, text", [
    ("<body><div class=sidebar>Side words here, many of them.</div><main><h2>T</h2><p>A<i>b</i>c, d.</p><ul><li>x</ul></main>", "T Abc, d. x"),
    ("<div id='cookie-notice'><p>We use cookies. Accept them, please.</p></div><div class=post><p>Long enough text, it says. Really.</p>"
     "<p>And a second one, here.</p></div><aside>Other things</aside><form><p>Your name?</p></form>",
     "Long enough text, it says. Really. And a second one, here."),
    ("<nav><ul><li>Home<article><p>Unclosed menu before, still text.</p></article>", "Unclosed menu before, still text."),
    ("<article><p>Text one, fine.</p><section class=comments><article><p>Nice post, thanks a lot!</p></article></section></article>",
     "Text one, fine."),
    ("<article><p>a &lt;p&gt; &#233;&nbsp;b</p><script>x<y</script><!-- no --></article>", "a <p> é b")])
def test_page_cases(page, text):
    assert html_extraction.extract_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<body class='has-sidebar'><div class=sidebar>Side.</div><p>Text one, fine. It goes on.</p><p>Text two, here.</p></body>",
     "Text one, fine. It goes on. Text two, here."),
    ("<body><main class='with-sidebar'><p>Text one, fine.</p></main></body>", "Text one, fine."),
    ("<body><main class='sidebar'><p>Text one, fine.</p></main></body>", "Text one, fine."),
    ("<body class='comments-closed'><article class='post comments-open'><p>Text one, fine.</p>"
     "<div class='comment-list'><p>Nice.</p></div></article></body>", "Text one, fine."),
    ("<div class='no-banner'><p>Text one, fine.</p></div><div class='ad-slot'><p>Buy, now.</p></div>", "Text one, fine."),
    ("<div class='widget'><p>Text one, fine, and long enough.</p><p>Text two, here.</p></div><p>Short</p>",
     "Text one, fine, and long enough. Text two, here."),
    ("<div class='discussion'><article><p>Text one, fine.</p></article></div>", "Text one, fine."),
    ("<article><p>As <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation encoding='application/x-tex'>a=2</annotation></math>, so.</p></article>",
     "As a=2, so.")])
def test_names_that_do_not_spare(page, text):
    assert html_extraction.extract_text(page) == text


def test_trie_counts_equal_a_plain_viterbi(texts):
    scores = token_counts.unigram_scores(token_counts.vocabulary_file())
    trie = token_counts.PretokenTrie(scores)
    words = sorted({"▁" + w for t in list(texts.values())[:20] for w in t.split()} | {"▁", "▁漢x", "▁" + "z" * 50})
    found = trie.terminal_counts(words)
    assert trie.nodes < sum(map(len, words))  # shared prefixes were scored once
    for w in words:
        best = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            b = len(w[end - 1].encode())
            ways = [(best[end - 1][0] + token_counts.UNKNOWN * b, -best[end - 1][1] - b)]
            ways += [(best[s][0] + scores[w[s:end]], -best[s][1] - 1) for s in range(end) if w[s:end] in scores]
            top = max(ways)
            best.append((top[0], -top[1]))
        assert found[w][0] == best[-1][1] and found[w][1] == pytest.approx(best[-1][0])


def test_raked_weights_meet_the_targets():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 1000, 60).astype(float)
    classes = [np.arange(60) % 4, np.arange(60) // 4 % 5, np.arange(60) // 20]
    targets = [np.array(t) for t in ([0.4, 0.3, 0.2, 0.1], [0.2] * 5, [0.5, 0.3, 0.2])]
    weights = mixing.rake(tokens, classes, targets)
    for c, t in zip(classes, targets):
        assert np.bincount(c, weights=weights) == pytest.approx(t)
    chances = mixing.probabilities(tokens, weights, 0.3)
    assert (chances <= 1).all() and (chances * tokens).sum() == pytest.approx(0.3 * tokens.sum())


def test_a_rare_class_meets_its_target():
    tokens = np.array([1.0, 1999.0, 1.0, 1999.0])
    classes, targets = [np.array([0, 1, 0, 1]), np.array([0, 0, 1, 1])], [np.array([0.2, 0.8]), np.array([0.3, 0.7])]
    weights = mixing.rake(tokens, classes, targets)
    for c, t in zip(classes, targets):
        assert np.bincount(c, weights=weights) == pytest.approx(t)
    with pytest.warns(UserWarning, match="targets conflict"):  # the same documents cannot be 20 % and 30 %
        mixing.rake(tokens[:2], [np.array([0, 1])] * 2, targets)


def test_every_source_has_a_target(spark):
    rows = [(s, n) for s, n in (("src0", 50), ("hot", 900), ("b", 90), ("c", 9), (None, 1))]
    made = mixing.spread(spark.createDataFrame(rows, "source string, n_words long"), "source", {"src0": 0.4, "src1": 0.1, "*": 0.5}, 0.8)
    parts = {k: (n / 1000) ** 0.8 for k, n in (("hot", 900), ("b", 90), ("c", 9), ("*", 1))}
    assert made == pytest.approx({"src0": 0.4, "src1": 0.1} | {k: 0.5 * p / sum(parts.values()) for k, p in parts.items()})


def test_drawn_tokens_follow_the_probabilities(spark):
    rows = queries.QUERIES["op4_ipf_mixing"](spark, "/root/testdata/sf0.01").collect()
    expected = sum(r.probability * r.n_words for r in rows)
    spread = math.sqrt(sum(r.probability * (1 - r.probability) * r.n_words ** 2 for r in rows))
    assert abs(sum(r.n_words for r in rows if r.sampled) - expected) < 4 * spread
    assert expected == pytest.approx(mixing.BUDGET * sum(r.n_words for r in rows), rel=1e-6)
    shares = Counter()
    for r in rows:
        shares[r.lang] += r.weight * r.n_words
    wanted = {k: v for k, v in mixing.TARGETS["lang"].items() if k in shares}
    assert all(shares[k] == pytest.approx(v / sum(wanted.values()), abs=1e-6) for k, v in wanted.items())


def test_topics_are_fitted_on_all_documents(spark):
    """Means over all distinct texts, also of a language with 3 rows in 5,000; copies change nothing."""
    rng = random.Random(8)
    rows = [(i, "src0", "fr" if i % 2000 == 7 else "en", " ".join(f"w{rng.randrange(300)}" for _ in range(20))) for i in range(5000)]
    kinds, langs = "doc_id long, source string, lang string, text string", mixing.TARGETS["lang"]

    def fitted(made):
        docs = spark.createDataFrame(made, kinds).repartition(5)
        return mixing.fit_topics(mixing.profile(docs, ["doc_id", "lang"]), langs, rounds=3)

    model = fitted(rows)
    for lang in ("en", "fr"):
        vectors = [np.sqrt(np.bincount(shingles.word_hashes(r[3].encode()) % np.uint64(256), minlength=256)) for r in rows if r[2] == lang]
        assert model.means[lang] == pytest.approx(np.mean([v / np.linalg.norm(v) for v in vectors], axis=0), abs=1e-8)
    copied = fitted(rows + [(i, *rows[0][1:]) for i in range(5000, 7500)])
    assert (copied.centres == model.centres).all() and all((copied.means[k] == model.means[k]).all() for k in model.means)


def test_replies_follow_the_turns(spark):
    """In the stand-in mail every turn quotes the one before, unless that has no text."""
    rows = queries.QUERIES["op1_quotation_linking"](spark, SF).collect()
    own = {(r.conv_id, r.turn): r.text for r in table(spark, "conversations").collect()}
    assert len(rows) == len(own)
    for r in rows:
        assert re.sub(r"\s+", " ", r.content).strip() == re.sub(r"\s+", " ", own[r.conv_id, r.turn]).strip()
        assert r.parent_turn == (r.turn - 1 if r.turn else None) and r.reply_order == r.turn
        assert r.n_quotes == min(r.turn, 2) and r.n_linked == r.n_quotes


def test_a_repeated_text_is_linked_to_its_latest_writer(spark):
    """Greetings written in many turns, against a plain search; the hot line spans several cuts of the order."""
    from glazier.llm import quotation_linking
    rng = random.Random(9)
    rows, wanted = [], {}
    for conv in range(4):
        own = []
        for turn in range(300 if conv == 0 else 12):
            text = rng.choice(["Hello there.", "Thank you!", f"Answer {turn} of mine."])
            # A quotation of a writer, as its latest copy before this turn.
            quoted = rng.choice(own) if own else None
            rows.append((conv, turn, "user", f"> {quoted}\n{text}" if quoted else text))
            wanted[conv, turn] = max(i for i, t in enumerate(own) if t == quoted) if quoted else None
            own.append(text)
    found = quotation_linking.link_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in found} == wanted
    assert all(r.n_linked == r.n_quotes for r in found)

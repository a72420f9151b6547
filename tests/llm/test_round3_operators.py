"""Operators 11 to 13 against brute force."""
import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from glazier.llm import byte_bpe, hard_negatives, periodic_runs
from glazier.llm.common import read_table

SF = "/root/testdata/sf0.001"


# --- 11 ---------------------------------------------------------------------------------------------

def mined(rows, every=100):
    """Brute force over (vec_id, label, vector) rows that take part."""
    scaled = [(i, lab, np.floor(np.array(v, float) * 256).astype(np.int64)) for i, lab, v in rows]
    out = []
    for a, label, v in scaled:
        if a % every:
            continue
        scored = [(-int(w @ v), i, lab == label) for i, lab, w in scaled if i != a and len(w) == len(v)]
        for minus, p, _ in sorted(x for x in scored if x[2])[:5]:
            good = sorted((s, i) for s, i, same in scored if not same and 80 * -minus <= 100 * -s <= 100 * -minus)[:5]
            out += [(a, p, r, i, -minus, -s) for r, (s, i) in enumerate(good, 1)]
    return sorted(out)


def mining(df, **more):
    return sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(df, **more).collect())


@pytest.mark.parametrize("dim,spread", [(3, 1.0), (64, 1.0), (70, 0.05)])
def test_hard_negatives_equal_brute_force(spark, dim, spread):
    draw = np.random.default_rng(dim)
    centres = draw.standard_normal((4, dim))
    rows = [(int(i), int(draw.integers(3)), [float(x) for x in np.float32(centres[i % 4] + spread * draw.standard_normal(dim))])
            for i in draw.permutation(400)]
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(40)] + [(2000, 1, [0.0] * dim), (2001, 2, [-x for x in rows[0][2]])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    assert mining(df, every=20) == mined(rows, 20)


def test_hard_negatives_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 4)
    draw = np.random.default_rng(5)
    rows = [(i, i % 2, [float(x) for x in np.float32(draw.standard_normal(8))]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert mining(df, every=10) == mined(rows, 10)


def test_intervals_hold_the_scores_and_cut_most_rows():
    draw = np.random.default_rng(1)
    rows = np.floor(draw.standard_normal((4000, 64)) * 32).astype(np.int64)
    anchors = rows[:20]
    codes, aligned, rest = hard_negatives.encode(rows)
    estimate, slack = hard_negatives.interval(anchors, codes, aligned, rest, np.linalg.norm(rows, axis=1))
    scores = anchors @ rows.T
    assert (np.abs(scores - estimate) <= slack).all()
    fifth = np.sort(scores, axis=1)[:, -6]
    assert (estimate + slack >= fifth[:, None]).mean() < 0.1


def test_hard_negatives_edge_tables(spark, edge_dir, empty_dir):
    got = [tuple(r) for r in hard_negatives.op11_onebit_hard_negatives(spark, edge_dir).collect()]
    kept = {}
    for r in read_table(spark, edge_dir, "embeddings").collect():
        if r.vec_id is None or r.label is None or r.embedding is None or any(
                x is None or not math.isfinite(x) or abs(x) > 1e5 for x in r.embedding):
            continue
        row = ((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
        kept[r.vec_id] = min(kept.get(r.vec_id, row), row)
    assert sorted(got) == mined([(i, *row) for i, row in kept.items()])
    assert hard_negatives.op11_onebit_hard_negatives(spark, empty_dir).count() == 0


# --- 12 ---------------------------------------------------------------------------------------------

def runs_of(words, least=24):
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 3 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, e - a, p) for (a, e), p in found.items())


def words_of(text):
    return (text or "").encode().split()


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def periodic_row(doc_id, text):
    words = planted(doc_id, words_of(text))
    runs = runs_of(words)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_brute_force(seed):
    draw = random.Random(seed)

    def text():
        words = [draw.randrange(draw.choice([1, 2, 3, 50])) for _ in range(draw.randrange(200))]
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(words) + 1)
            block = words[at:at + draw.randrange(1, 40)]
            if draw.random() < 0.4:  # a highly periodic stretch inside the period
                block = (block[:draw.randrange(1, 4)] * 40)[:draw.randrange(2, 40)]
            words[at:at] = (block * draw.randrange(2, 9))[:draw.randrange(250)]
        return [b"%d" % w for w in words]

    a, b = [b"0"], [b"0", b"1"]
    for _ in range(11):
        a, b = b, b + a
    for least in (24, 3):
        texts = [text() for _ in range(40)] + [b, [], [b"x"] * 700, ([b"x"] * 9 + [b"y"]) * 40]
        got = periodic_runs.runs_of_texts(texts, least)
        assert [[tuple(r) for r in rows.tolist()] for rows in got] == [runs_of(t, least) for t in texts]


def test_a_long_text_of_nested_periods_takes_n_log_n():
    block = [b"%d" % (i % 5) for i in range(60)] + [b"z"]
    words = (block * 300 + [b"q"]) * 16          # 292,816 words, periods 5, 61 and 18,301
    runs = [tuple(r) for r in periodic_runs.runs_of_texts([words])[0].tolist()]
    assert (0, len(words), 18301) in runs
    assert sum(p == 61 for _, _, p in runs) == 16
    assert sum(p == 5 for _, _, p in runs) == 300 * 16


def test_periodic_query_equals_brute_force(spark, edge_dir, empty_dir):
    for folder in (SF, edge_dir):
        expected = [periodic_row(r.doc_id, r.text)
                    for r in read_table(spark, folder, "documents").collect() if len(words_of(r.text)) < 5000]
        got = [tuple(r) for r in periodic_runs.op12_periodic_runs(spark, folder).collect()]
        key = lambda r: tuple(-1 if x is None else x for x in r)
        held = {r[0] for r in expected}
        assert sorted((r for r in got if r[0] in held), key=key) == sorted(expected, key=key)
        assert len(got) == read_table(spark, folder, "documents").count()
    assert periodic_runs.op12_periodic_runs(spark, empty_dir).count() == 0


# --- 13 ---------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def reference():
    import tiktoken
    with open(byte_bpe.tokenizer_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("reference", pat_str=byte_bpe.pattern(), mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    vocab = byte_bpe.vocabulary(byte_bpe.tokenizer_file())
    ids, places, before = byte_bpe.encode_group(b"".join(data), offsets, vocab, byte_bpe._classes_of(byte_bpe.class_table()))
    return [(ids[a:b], places[a:b]) for a, b in zip(before, before[1:])]


def test_ids_equal_the_library(reference):
    draw = random.Random(3)
    letters = "  \n\t's'stmdrvel1'!é漢 ٩😀\x1c\x85abreleva'ree ''"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(50))) for _ in range(5000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 2000, "漢字" * 2000, "'" * 300, "", "<|endoftext|>", "don't 're'RE we'll've"]
    vocab = byte_bpe.vocabulary(byte_bpe.tokenizer_file())
    for text, (ids, places) in zip(texts, encoded(texts)):
        assert ids.tolist() == reference.encode_ordinary(text), text
        assert vocab.decode(ids, places) == text.encode()


def test_every_code_point_has_the_library_s_class(reference):
    for start in range(0, 0x110000, 4096):
        chars = [chr(c) for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c} 1{c}!{c} {c}" for c in chars)
        assert encoded([text])[0][0].tolist() == reference.encode_ordinary(text)


def test_windows_hand_on_the_state():
    text = "it's  a\n\n test of 'runs' 've   x漢字 '".encode()
    texts = np.array([0, 9])
    classes = byte_bpe._classes_of(byte_bpe.class_table())
    whole = byte_bpe.slice_starts(text, texts, classes)
    for window in range(1, 12):
        assert byte_bpe.slice_starts(text, texts, classes, window).tolist() == whole.tolist()


def test_both_merges_agree():
    draw = random.Random(9)
    ranks = byte_bpe.vocabulary(byte_bpe.tokenizer_file()).ranks
    for _ in range(300):
        piece = "".join(draw.choice("abcdefe the漢") for _ in range(draw.randrange(1, 90))).encode()
        assert byte_bpe._merge_short(piece, ranks) == byte_bpe._merge_long(piece, ranks)


def test_bpe_query_equals_the_library(spark, reference, edge_dir, empty_dir):
    for folder in (SF, edge_dir):
        expected = []
        for r in read_table(spark, folder, "documents").collect():
            ids = reference.encode_ordinary(r.text or "")
            expected.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256((r.text or "").encode()).hexdigest()))
        got = [tuple(r) for r in byte_bpe.op13_byte_bpe(spark, folder).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert byte_bpe.op13_byte_bpe(spark, empty_dir).count() == 0


# --- earlier operators mended this round ----------------------------------------------------------------

@pytest.mark.parametrize("piece", ["<script ", '<a "', "<a \"'>", "<div>x", "<", "<!--", "<div><ul><li>a, b. "])
def test_malformed_pages_take_linear_time(piece):
    import time

    from glazier.llm.html_extraction import extract_text
    page = "<article><p>" + piece * (1_000_000 // len(piece))
    began = time.process_time()
    extract_text(page)
    assert time.process_time() - began < 12


def test_unclosed_markup_is_text():
    from glazier.llm.html_extraction import _tokens, extract_text
    assert extract_text("<p>one <a href='x>y'>two</a> <b three.") == "one two <b three."
    assert [t[2:] for t in _tokens("<p x=\">\"><script a>b</SCRIPT ><!--c><br/><q 'r>")] == [
        ("p", False, ' x=">"'), ("", False, ""), ("", False, "")]


def test_documents_without_id_are_drawn_apart(spark):
    from glazier.llm.mixing import profile
    docs = spark.createDataFrame([(None, f"words of text {i // 2}") for i in range(40)], "doc_id long, text string")
    drawn = [r.uniform for r in profile(docs, ["text"]).collect()]
    assert len(set(drawn)) == 20 and 0.2 < sum(drawn) / 40 < 0.8


PLAIN_PAGE = ("<body><div><ul><li><a href=/a>One</a><li><a href=/b>Two</a><li><a href=/c>Three</a></ul></div>"
              "<div><h2>Head</h2><p>The first paragraph is long, and it says much. It goes on.</p>"
              "<p>The second one is long as well, with commas, and it ends here.</p><p>Short end.</p></div>"
              "<div><ul><li><a href=/d>Imprint</a><li><a href=/e>Contact</a></ul></div></body>")
PLAIN_TEXT = ("Head The first paragraph is long, and it says much. It goes on. "
              "The second one is long as well, with commas, and it ends here. Short end.")


def test_path_scores_decide_without_article_and_names(monkeypatch):
    from glazier.llm import html_extraction
    assert html_extraction.extract_text(PLAIN_PAGE) == PLAIN_TEXT
    with_article = "<body><nav><p>Menu</p></nav><article><p>Text one, fine. It goes on.</p></article><footer>Foot.</footer></body>"
    assert html_extraction.extract_text(with_article) == "Text one, fine. It goes on."
    monkeypatch.setattr(html_extraction, "path_scores", lambda blocks: {b.path: 1.0 for b in blocks})
    assert html_extraction.extract_text(PLAIN_PAGE) != PLAIN_TEXT
    assert html_extraction.extract_text(with_article) == "Menu Text one, fine. It goes on. Foot."


def test_lexicon_matches_as_a_plain_scan():
    import random
    from glazier.llm import toxicity
    rng = random.Random(5)
    for _ in range(300):
        stems = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 6))) for _ in range(4)}
        whole = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(2)}
        weights = {t: rng.uniform(1, 5) for t in stems} | {w + " ": rng.uniform(1, 5) for w in whole}
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 30))]
        pair = rng.randrange(len(words))
        spared = [" ".join(words[pair:pair + 2])] if rng.random() < 0.5 and pair + 1 < len(words) else []
        free = [True] * len(words)
        for i in range(len(words) - 1):
            if " ".join(words[i:i + 2]) in spared:
                free[i] = free[i + 1] = False
        want = sum(max([v for t, v in weights.items() if (w + " " == t if t.endswith(" ") else w.startswith(t))], default=0.0)
                   for w, counts in zip(words, free) if counts)
        found = toxicity.Matcher(toxicity.Lexicon(weights, spared)).found(toxicity.fold(" ".join(words)))
        assert abs(found - want) < 1e-9, (weights, spared, words)


def test_chosen_terms_do_not_begin_each_other():
    from glazier.llm import toxicity
    rows = [{"term": t, "by_uses": v} for t, v in (("idio", 9.0), ("idiot", 9.0), ("id ", 8.0), ("scum", 5.0), ("scu ", 7.0), ("idiots", 3.0))]
    assert [r["term"] for r in toxicity.choose_terms(rows)] == ["idiot", "scu "]


def test_repeated_vector_ids_count_by_their_least_row(spark):
    from glazier.llm.embedding_dedup import near_duplicates
    rows = [(1, [0.0, 1.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.0], 1)]
    for order in (rows, rows[::-1]):
        found = near_duplicates(spark.createDataFrame(order, "vec_id long, embedding array<float>, label int").repartition(3))
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]

"""Small tables with the cases every operator must handle."""
import os

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog near the old river bank while seven birds sing above the hill"
# doc_id, text, lang, source, n_chars
DOCUMENTS = [
    (0, "", "en", "src0", 0), (1, None, None, None, None), (2, "one two", "en", "src0", 7), (3, LONG, "de", "src1", len(LONG)),
    (4, LONG, "de", "src1", len(LONG)), (5, BASE, "en", "src0", 90), (5, BASE, "en", "src0", 90),
    (6, BASE + " again", "fr", "src2", 96), (7, BASE.upper(), "en", None, 90), (8, "   \n\t ", "es", "src0", 6),
    (None, "a row without an id keeps its words", "en", "src3", 35), (9, "é ß 漢字 😀 <|endoftext|>  two  spaces\n\nend ", "en", "src0", 40),
    (2**62, "the far id of a small text", "en", "src0", 26), (-7, "a negative id of a small text", "en", "src0", 29)]
LABELS = [(i, 1, int(i in (6, 9))) for i in range(10)] + [(5, 0, None), (None, 1, 1), (9, 1, 1)]
PAGES = [(0, "u", None), (1, None, ""), (2, "u", "just text &amp; more"), (2, "u", "just text &amp; more"),
         (3, "u", "<html><body><nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>Main <b>te</b>xt, here.<p>Two&nbsp;&lt;b&gt;."
                  "<div class='comments'><p>A reader wrote this.</p></div></article><footer>Foot.</footer>"),
         (None, "u", "<p>" + "long words, many. " * 20_000 + "</p>"), (5, "u", "<script>var a='<p>x</p>';</script><style>p{}</style>")]
VECTORS = [(0, [1.0, 0.0, 0.0], 1), (1, [2.0, 0.1, 0.0], 1), (2, [0.0, 1.0, 0.0], 1), (3, [1.0, 0.0, 0.0], None), (4, None, 1),
           (5, [0.0, 0.0, 0.0], 1), (6, [float("nan"), 1.0, 0.0], 1), (7, [1.0, None, 0.0], 1), (8, [1.0, 0.0], 1),
           (9, [1.0, 0.0, 0.0], 2), (9, [1.0, 0.0, 0.0], 2), (None, [1.0, 0.0, 0.0], 1), (10, [1e30, 1e28, 0.0], 1),
           (11, [float("inf"), 0.0, 0.0], 1), (12, [], 1)]
TURNS = [(1, 0, "user", "How do I sort\nthis list?"), (1, 1, "assistant", "> How do I sort\n> this list?\nUse sorted."),
         (1, 2, "user", "> > How do I   sort\n> Use sorted.\nThanks!"), (1, 3, "user", "> how do i sort\nMe too"),
         (2, 0, "user", None), (2, 1, None, ""), (2, 1, None, ""), (None, 0, "user", "lost"), (3, None, "user", "> nothing known\nhi")]
NAMES = ("shard", "slot", "score", "fingerprint", "n_words", "topic", "component_id", "sampled", "group", "row", "_n", "weight")


def save(spark, folder, name, rows, kinds, keep=True):
    df = spark.createDataFrame(rows, kinds)
    df = df.withColumns({c: F.lit(c) for c in NAMES if c not in df.columns})
    (df if keep else df.limit(0)).repartition(2).write.parquet(os.path.join(folder, f"{name}.parquet"))


def tables(spark, folder, keep=True):
    save(spark, folder, "documents", DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long", keep)
    save(spark, folder, "labels", LABELS, "doc_id long, quality int, toxic int", keep)
    save(spark, folder, "pages", PAGES, "page_id long, url string, html string", keep)
    save(spark, folder, "embeddings", VECTORS, "vec_id long, embedding array<float>, label int", keep)
    save(spark, folder, "conversations", TURNS, "conv_id long, turn long, role string, text string", keep)
    return str(folder)

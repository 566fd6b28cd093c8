import numpy as np
import pyarrow as pa

from pricelake.llm import decontam, text as tx

ITEMS = [
    (1, "Yesterday Anna bought 12 apples for 3 dollars and then Anna gave 12 of the apples to her brother Tom in town."),
    (2, "short item text"), (3, None), (4, ""), (5, "It went on and on until the very last of them had left the old house by the sea"),
    (5, "It went on and on until the very last of them had left the old house by the sea"),
    (6, "La. Éai éonleeau pour an éonqueê aivi ai, éenaitreoiaux éoiré anvitre èenreré ouantre le. Oueuxoi les."),
]


def kinds(text):
    block = next(tx.blocks([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])], "text"))
    return decontam.Tokens(block).kind.tolist()


def test_kinds():
    assert kinds("The boy Tom ran 5 km. Later m, (Bob) said: \"Fine\" 3.5 kg\nEnd") == [0, 0, 3, 0, 1, 2, 0, 0, 3, 0, 0, 1, 2, 0]
    assert kinds("twelve ... %%% ALL caps") == [1, 0, 0, 0]


def test_letters_beyond_ascii():
    assert kinds("le garçon Émile vit Éé ÉÉ É 5 km") == [0, 0, 3, 0, 3, 0, 0, 1, 2]
    assert kinds("-" * 40 + " one " + "." * 30 + "Tom" + "!" * 30) == [1, 3]
    points = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    same = [c for c in points if len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode())]
    text = "".join(same) + "😀"
    raw = np.frombuffer(text.encode(), np.uint8)
    assert decontam.lower(raw).tobytes().decode() == "".join(c.lower() for c in text)
    assert len(decontam.lower(raw[:0])) == 0


def run(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS hash")
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item")
    hits = sorted({(r.id, r.item) for r in decontam.contaminated(frame, items).collect()}, key=str)
    left = decontam.drop_contaminated(frame, items)
    assert left.columns == frame.columns
    return hits, sorted((r.doc_id for r in left.collect()), key=str)


def test_cases(spark):
    say = ITEMS[0][1]
    other = say.replace("Anna", "Mary").replace("12", "75").replace(" 3 ", " 8 ").replace("Tom", "Jim")
    jumbled = other.replace("gave 75", "gave 80")
    words = ITEMS[4][1].split()
    docs = [
        (1, "Some lead. " + say + " Some tail."), (2, other), (3, jumbled), (4, say.upper()), (5, None), (6, ""),
        (7, "a short item text here"), (8, " ".join(words[:14])), (9, " ".join(words[:7]) + " else"),
        (10, "Nothing of it is in here at all, not one bit of the thing"), (None, "x " + say), (11, say), (11, say), (11, "clean"),
        (12, "( " + ITEMS[4][1].replace(" ", "  ").upper() + " )"), (13, "!! ".join(ITEMS[6][1].upper().split()))]
    hits, left = run(spark, docs)
    assert hits == sorted([(1, 1), (2, 1), (4, 1), (7, 2), (8, 5), (None, 1), (11, 1), (12, 5), (13, 6)], key=str)
    assert (3, 1) not in hits
    assert set(left) >= {3, 5, 6, 9, 10, 11} and not set(left) & {1, 2, 4, 7, 8, 12, 13, None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contaminated(none, items).collect() == []
    assert decontam.contaminated(none.union(spark.createDataFrame([(1, "a b c d e f g h i")], none.schema)), items.limit(0)).collect() == []


def test_verbatim_items(spark, sf):
    """Every document that holds a whole item is found, and nothing else."""
    sf = "/root/testdata/sf0.01"
    from pricelake.llm.queries import QUERIES

    items = [(r.item_id, " ".join(r.text.split())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()
            for i, t in items if t in " ".join(r.text.split())}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_template_decontamination"](spark, sf).collect()}
    assert want and got == want


def test_generated_parameters_and_jumbled_twins(spark):
    """100 items with other names and numbers throughout are found, twins with one slot jumbled are not."""
    import random

    rng = random.Random(12)
    names = ["Anna", "Bert", "Cleo", "Dora", "Emil", "Fred", "Gina", "Hugo", "Ines", "Jack", "Kira", "Luis"]
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(4, 8)))
    items, same, jumbled = [], [], []
    for i in range(100):
        w = [word() for _ in range(24)]
        form = " ".join(["The", *w[:3], "{a}", *w[3:6], "{n}", *w[6:8], "and", *w[8:10], "{b}", *w[10:13], "{n}", *w[13:16], "{a}",
                         *w[16:19], "{m}", *w[19:21], "{c}", *w[21:]])
        a, b, c, d = rng.sample(names, 4)
        n, m, k, o = rng.sample(range(10, 10_000), 4)
        fill = lambda **kw: form.format(**kw)
        items.append((i, fill(a=a, b=b, c=a, n=n, m=m)))
        same.append((i, fill(a=c, b=d, c=c, n=k, m=o)))
        parts = form.replace("{c}", "{a}").split("{n}") if i % 2 else form.split("{c}")
        # Another number where the first one stood, or another name where the same one stood.
        twin = f"{parts[0]}{k}{parts[1]}{k + 1}{parts[2]}" if i % 2 else f"{parts[0]}{d}{parts[1]}".replace("{n}", str(k))
        jumbled.append((1000 + i, twin.format(a=c, b=b, m=o)))
    frame = spark.createDataFrame(same + jumbled, "doc_id long, text string")
    found = {(r.id, r.item) for r in decontam.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {i for i, _ in same} <= {i for i, _ in found}
    assert all(i == item for i, item in found)


def test_null_ids_are_told_apart_by_their_texts(spark):
    say = ITEMS[4][1]
    rows = [(None, f"clean text number {i}") for i in range(300)] + [(None, f"{i} {say}") for i in range(3)]
    hits, left = run(spark, rows)
    assert hits == [(None, 5)] and len(left) == 300

import pytest

from ostinato.llm import names

ENTRIES = ["serene", "solemn", "drowsy", "weary", "jubilant", "whispered", "mechanical", "slow and heavy", "slow and steady", "half voice", "full voice", "with bent pitch", "like a march", "like a lullaby", "cold precision", "dry staccato", "bright and hurried", "light on tiptoe", "tender"]
MEANT = {
    "Serene": "serene", " SERENE #4\n": "serene", "3_Serene": "serene", "[2] serene": "serene", "clip 3: serene": "serene", "serene (take 2)": "serene", "serene, v3": "serene", "serene.wav  ": "serene", "serene bis": "serene",
    "s e r e n e": "serene", "ѕerеnе": "serene", "ｓｅｒｅｎｅ4": "serene", "sérene": "serene", "s0lemn": "solemn", "solmen": "solemn", "DROEWSY;": "drowsy", "eeary-t1  ": "weary", "jubil.": "jubilant", "JUBILANT_04": "jubilant",
    "whispd": "whispered", "mech.": "mechanical", "slow, heavy": "slow and heavy", "heavy & slow": "slow and heavy", "Slo Wand Steaady": "slow and steady", "voice: half4": "half voice", "half v.": "half voice", "pitch bent, with": "with bent pitch",
    "bent pitch": "with bent pitch", "w/ bent pitch": "with bent pitch", "march-like": "like a march", "a lullaby": "like a lullaby", "cold prec.": "cold precision", "Coldprecision1": "cold precision", "dry stacc.": "dry staccato", "bright/hurr.": "bright and hurried",
    "on tiptoe, light": "light on tiptoe", "halfxvooice": "half voice",
}
FOREIGN = ["", "   ", "\n", "bluesy", "groovy", "reed swap", "operator talking", "1st half of tune!", "false start", "clip 7", "# 2", "take", "mic check", "x", "12", "n.n.", "test", "voice", "slow", "-", "😀", "a" * 5000]


@pytest.fixture(scope="module")
def mapped(spark):
    said = [*MEANT, *FOREIGN, None, "Serene", None]
    rows = spark.createDataFrame([(i, n, 5, "q", 0.5) for i, n in enumerate(said)] + [(None, "serene", 5, "q", 0.5)], "ver_id long, ver_name string, entry_id int, entry string, score double")
    entries = spark.createDataFrame([(i, e, "n") for i, e in enumerate(ENTRIES)] + [(99, "serene", "n"), (100, None, "n"), (101, " ", "n")], "expr_id int, expr_name string, name string")
    return said, names.map_names(rows, "ver_id", "ver_name", entries, "expr_id", "expr_name").collect()


def test_every_row_once(mapped):
    said, rows = mapped
    assert len(rows) == len(said) + 1
    assert {r["ver_id"]: r["ver_name"] for r in rows if r["ver_id"] is not None} == dict(enumerate(said))
    assert [r["expr_id"] for r in rows if r["ver_id"] is None] == [0]


def test_meant_and_foreign(mapped):
    _, rows = mapped
    got = {r["ver_name"]: r["expr_name"] for r in rows}
    assert {n: got[n] for n in MEANT} == MEANT
    assert {n: got[n] for n in FOREIGN} == dict.fromkeys(FOREIGN)
    assert got[None] is None


def test_empty(spark):
    rows = spark.createDataFrame([(1, "serene")], "ver_id long, ver_name string")
    none = spark.createDataFrame([], "expr_id int, expr_name string")
    assert [r["expr_id"] for r in names.map_names(rows, "ver_id", "ver_name", none, "expr_id", "expr_name").collect()] == [None]
    some = spark.createDataFrame([(1, "serene")], "expr_id int, expr_name string")
    assert names.map_names(rows.limit(0), "ver_id", "ver_name", some, "expr_id", "expr_name").count() == 0


def test_edits():
    assert names.edits("abcd", "abdc") == 1 and names.edits("", "abc") == 3 and names.edits("kitten", "sitting") == 3


def test_blocking_loses_no_close_pair(spark):
    """All pairs of tokens and words that are close share a pair of letters and pass the filter ahead of Python."""
    from pyspark.sql import functions as F

    words = sorted({(w, whole) for e in [*ENTRIES, "with great tenderness"] for w, _, whole in names.tokens(e)})
    said = sorted({(t, m, whole) for n in [*MEANT, *FOREIGN, "withgreattender", "with great tenderly"] for t, m, whole in names.tokens(n) if len(t) < 100})
    close = {(t, m, whole, w) for t, m, whole in said for w, other in words if other == whole and names.closeness(t, w, m, whole) >= names.CLOSE}
    assert ("withgreattender", False, True, "withgreattenderness") in close
    pairs = spark.createDataFrame([(t, m, whole, w) for t, m, whole in said for w, other in words if other == whole], "token string, marked boolean, whole boolean, word string")
    kept = pairs.filter(F.arrays_overlap(names._grams("token"), names._grams("word")) & names._may_be_close()).collect()
    assert close <= {tuple(r) for r in kept}
    assert len(kept) < pairs.count() / 5

"""Lines, tokens, names and areas against a plain Python reading of whole pages; phrases and legends against given cases."""

import random
import re
import time
import timeit

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planwright import plans
from planwright.functions import legend
from planwright.functions import strings as S
from planwright.operators import layout, phrases

WORD = "page bigint, word_no bigint, text string, x_min double, y_min double, x_max double, y_max double"


def plain_lines(words):
    lines = []
    for w in sorted(words, key=lambda w: ((w[4] + w[6]) / 2, w[1], w[2], *w[3:7])):
        h, c = max(1, w[6] - w[4]), (w[4] + w[6]) / 2
        for line in lines:
            if abs(line["c"] - c) < 0.5 * min(line["h"], h):
                line["w"].append(w)
                line["c"] = (line["c"] * (len(line["w"]) - 1) + c) / len(line["w"])
                line["h"] = max(line["h"], h)
                break
        else:
            lines.append({"c": c, "h": h, "w": [w]})
    return lines


def plain_tokens(words):
    out = []
    for k, line in enumerate(plain_lines(words)):
        made = []
        for w in sorted(line["w"], key=lambda w: w[3]):
            if made and w[3] - made[-1]["x_max"] <= made[-1]["height"]:
                t = made[-1]
                t["text"] = f"{t['text']} {w[2]}".strip()
                t["x_max"], t["y_min"], t["y_max"] = w[5], min(t["y_min"], w[4]), max(t["y_max"], w[6])
                t["height"] = max(t["height"], max(1, w[6] - w[4]))
            else:
                made.append({"line": k, "text": w[2], "x_min": w[3], "y_min": w[4], "x_max": w[5], "y_max": w[6], "height": max(1, w[6] - w[4])})
        out += made
    return out


def plain_pairs(words):
    page = plain_tokens(words)
    blocks = sorted([dict(t) for t in page if layout.is_name(t["text"])], key=lambda b: (b["y_min"], b["x_min"]))
    i = 0
    while i < len(blocks):
        a, j = blocks[i], i + 1
        while j < len(blocks):
            b = blocks[j]
            gap = b["y_min"] - a["y_max"]
            if -0.6 * a["height"] <= gap < 2.5 * a["height"] and min(a["x_max"], b["x_max"]) - max(a["x_min"], b["x_min"]) > -a["height"]:
                a["text"] = f"{a['text']} {b['text']}".strip()
                a["x_min"], a["x_max"] = min(a["x_min"], b["x_min"]), max(a["x_max"], b["x_max"])
                a["y_min"], a["y_max"], a["height"] = min(a["y_min"], b["y_min"]), max(a["y_max"], b["y_max"]), max(a["height"], b["height"])
                blocks.pop(j)
            else:
                j += 1
        i += 1
    found, used = [], set()
    for k, t in enumerate(page):
        m = re.match(r"^(\d{1,3}\.\d{2})\s+m(²|2)$", t["text"])
        nxt = page[k + 1] if k + 1 < len(page) else None
        if m:
            area, box, h = float(m[1]), (t["x_min"], t["y_min"], t["x_max"], t["y_max"]), t["height"]
        elif re.match(r"^\d{1,3}\.\d{2}$", t["text"]) and nxt and re.match(r"^m(²|2)$", nxt["text"].strip()):
            area, box, h = float(t["text"]), (t["x_min"], t["y_min"], nxt["x_max"], max(t["y_max"], nxt["y_max"])), t["height"]
        else:
            continue
        if not 0 < area < 500:
            continue
        best = None
        for n, b in enumerate(blocks):
            far = (((box[0] + box[2]) / 2 - (b["x_min"] + b["x_max"]) / 2) ** 2 + ((box[1] + box[3]) / 2 - (b["y_min"] + b["y_max"]) / 2) ** 2) ** 0.5
            if n not in used and far <= max(60, 12 * h) and (best is None or far < best[0]):
                best = (far, n)
        if best:
            used.add(best[1])
            found.append((blocks[best[1]]["text"].strip(), area, round(best[0], 6)))
    return found


def pages(seed, n_pages=4, n=120):
    rnd, out = random.Random(seed), []
    for page in range(n_pages):
        for k in range(n):
            text = rnd.choice(["LIVING", "BEDROOM", "02", "MAID'S", "D05", "GF-04", "SCALE", "m²", "19.04", "12.50 m2", "Kitchen", "BATH"])
            x, y, h = rnd.uniform(0, 400), round(rnd.uniform(0, 300) / 4) * 4.0 + rnd.uniform(-1, 1), rnd.choice([0.5, 8.0, 10.0])
            out.append((page, k, text, x, y, x + 6.0 * len(text), y + h))
    return out


@pytest.mark.parametrize("partitions", [1, 64])
def test_pages_read_alike_however_they_are_dealt(spark, partitions):
    words = pages(3)
    random.Random(1).shuffle(words)
    data = spark.createDataFrame(words, WORD).repartition(partitions)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        tokens = layout.tokens(layout.lines(data)).orderBy("page", "line", "token").collect()
        got = [(r.page, r.name, r.area_m2, round(r.distance, 6)) for r in layout.room_areas(data).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    of = lambda p: [w for w in words if w[0] == p]
    assert [(r.page, r.line, r.text) for r in tokens] == [(p, t["line"], t["text"]) for p in range(4) for t in plain_tokens(of(p))]
    assert sorted(got) == sorted((p, *x) for p in range(4) for x in plain_pairs(of(p))) and len(got) > 20


def test_odd_words_and_no_words(spark):
    rows = [(1, 1, "HALL", 0.0, 0.0, 20.0, 8.0), (1, 1, "HALL", 0.0, 0.0, 20.0, 8.0), (None, 2, "LOST", 0.0, 0.0, 1.0, 1.0), (1, 3, None, 0.0, 0.0, 1.0, 1.0), (1, 4, "X", None, 0.0, 1.0, 1.0), (1, 5, "9.50 m²", 0.0, 12.0, 30.0, 20.0)]
    data = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], WORD + ", line string, height double")
    assert [(r.name, r.area_m2) for r in layout.room_areas(data).collect()] == [("HALL HALL", 9.5)]
    assert layout.room_areas(data.limit(0)).collect() == []
    assert [layout.is_name(t) for t in ("BEDROOM", "02", "D05", "CW 09", "GF-04", "SCALE 1", "Bath", "WC", "GROUNDS", "STORE/LINEN")] == [True, True, False, False, False, False, False, False, True, True]


def plain_phrases(words, names):
    keys = {}
    for n in names:
        keys[n.lower()] = min(n, keys.get(n.lower(), n))
    out, i = [], 0
    while i < len(words):
        for n in range(4, 0, -1):
            key = " ".join(words[i : i + n]).lower()
            if i + n <= len(words) and key in keys:
                out.append((i, n, keys[key]))
                i += n
                break
        else:
            i += 1
    return out


def test_phrases_are_taken_from_the_left(spark):
    rnd = random.Random(2)
    texts = [(k, [rnd.choice(["a", "b", "c", "A", "zz"]) for _ in range(rnd.randrange(60))]) for k in range(30)] + [(90, []), (91, ["a"] * 5000)]
    names = ["a b", "b a c", "c", "a a a a", "A b", "b zz", "zz c a b", "not there"]
    data = spark.createDataFrame(texts, "k int, words array<string>")
    got = phrases.find_phrases(data, ["k"], spark.createDataFrame([(n,) for n in [*names, None, ""]], "name string"), lambda c: F.lower(c)).collect()
    assert sorted((r.k, r.start, r.n, r["name"]) for r in got) == sorted((k, *p) for k, w in texts for p in plain_phrases(w, names))
    assert phrases.find_phrases(data.limit(0), ["k"], spark.createDataFrame([("a",)], "name string"), lambda c: c).collect() == []


def test_openings_of_one_word_are_looked_for(spark, tmp_path):
    """openings have one to four words; those of one word were left out."""
    texts = [(1, "alpha x Alpha beta y"), (2, "Beta alpha beta gamma delta epsilon gamma"), (3, None), (4, "beta")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "Alpha beta gamma  delta epsilon"), (2, "gamma"), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["Alpha", "Alpha beta", "Alpha beta gamma", "Alpha beta gamma delta", "gamma"]
    got = sorted((r.doc_id, r.start, r.n, r["name"]) for r in plans.QUERIES["c23_phrases"](spark, str(tmp_path)).collect())
    assert got == sorted((k, *p) for k, t in texts for p in plain_phrases((t or "").split(), names)) and (1, 0, 1, "Alpha") in got


def test_rooms_are_located_on_the_first_sheet(spark):
    words = spark.createDataFrame([(2, 1, "KITCHEN"), (1, 5, "MASTER"), (1, 6, "BEDROOM"), (1, 7, "BOH"), (3, 1, "BEDROOM"), (3, 2, None)], "sheet_id int, word_no int, text string")
    names = spark.createDataFrame([("BOH KITCHEN",), ("KITCHEN ROOM",), ("MASTER BEDROOM",), ("BEDROOM — GF",), ("ATTIC",)], "name string").withColumn("key", S.room_key(F.col("name")))
    got = {r["name"]: (r.sheet_id, r.word_no, r.n) for r in phrases.first_sheets(words, names, S.room_key).collect()}
    # A BOH kitchen is a kitchen.
    assert got == {"KITCHEN ROOM": (2, 1, 1), "BOH KITCHEN": (2, 1, 1), "MASTER BEDROOM": (1, 5, 2), "BEDROOM — GF": (1, 6, 1)}


def legends(spark, *texts):
    data = spark.createDataFrame(list(enumerate(texts)), "sheet int, text string")
    return {(r.sheet, r.code): (r.name, r.description, r.detail, r.line_no) for r in legend.legend_rows(data, ["sheet"]).collect()}


def test_legends(spark):
    codes = ["ST01", "ST02", "ST03", "PR01", "PR03", "WD01", "FN01", "FN02", "FN03", "FN04", "LS01", "LS02"]
    whole = "\r\n".join(f"MARBLE {c[:2]}\r\n      {c}                    Interior Floor Finish      I401\r\n   Honed 600 x 600" for c in codes) + "\n  BATHROOM  FINISHES (As per Bathroom Drawings)   ST01"
    got = legends(
        spark, whole, "PLAY SAND\n                    LS01                  19.04 m²                  Garden Hardscape", "GROUND FLOOR\n                    PR03                  Service Areas",
        "I401 A101 xST01 ST0 ST012", None, "", "ST01\n\n\n\n\nplain", "white marble\nPR01 tile      ST01      WD01 matt\nsize      PR01 2 x 2", "A\n\n\n\nST09")
    assert {k[1] for k in got if k[0] == 0} == {*codes, "BATHROOM"}
    assert got[0, "ST01"] == ("MARBLE ST", "Interior Floor Finish I401", "Honed 600 x 600", 2) and got[0, "BATHROOM"] == ("BATHROOM FINISHES", "As per Bathroom Drawings", None, 37)
    assert got[1, "LS01"] == ("PLAY SAND", "Garden Hardscape", None, 2) and got[2, "PR03"] == (None, "Service Areas", None, 2)
    assert got[6, "ST01"] == (None, None, None, 1)
    assert got[7, "PR01"] == (None, "tile WD01 matt", "PR01 2 x 2", 2) and got[7, "ST01"] == (None, "WD01 matt", "size      PR01 2 x 2", 2)
    assert not [k for k in got if k[0] in (3, 4, 5)] and got[8, "ST09"] == (None, None, None, 5)


def test_legend_of_a_long_text(spark):
    """The work follows the lines of a text: before, each line had the whole text divided once more."""
    lines = [f"            ST{k % 90 + 10}          plain {k}" if k % 40 == 0 else f"line {k} of a long text" for k in range(30_000)]
    began = time.time()
    got = legend.legend_rows(spark.createDataFrame([(1, "\n".join(lines))], "id int, text string"), ["id"]).collect()
    assert {r.code: (r.description, r.line_no) for r in got} == {f"ST{k % 90 + 10}": (f"plain {k}", k + 1) for k in range(29_960, -1, -40)}
    assert time.time() - began < 20


def test_runs_are_made_once(spark):
    """The runs of a text are not worked out again to filter the texts, and empty texts have none."""
    texts = spark.createDataFrame([(1, "a b  c"), (2, ""), (3, None)], "id int, text string").select("id", F.filter(F.split("text", " "), lambda w: w != "").alias("words"))
    out = phrases.windows(texts, ["id"], 2)
    assert sorted((r.id, r.start, r.n, r.phrase) for r in out.collect()) == [(1, 0, 1, "a"), (1, 0, 2, "a b"), (1, 1, 1, "b"), (1, 1, 2, "b c"), (1, 2, 1, "c")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1, plan


def test_batches_are_read_in_bulk():
    """rows are those of to_pylist(), nulls and all, at less than half of its time."""
    n = 100_000
    batch = pa.RecordBatch.from_pydict({"page": list(range(n)), "text": ["t"] * n, **{c: [0.1 * k for k in range(n)] for c in layout.BOX}})
    odd = pa.RecordBatch.from_pydict({"page": [1, None], "x": [None, 2.5], "text": [None, "a"]})
    assert list(layout._rows(iter([odd, batch]))) == odd.to_pylist() + batch.to_pylist()
    least = lambda read: min(timeit.repeat(read, number=1, repeat=3))
    assert least(lambda: list(layout._rows(iter([batch])))) < 0.5 * least(batch.to_pylist)


@pytest.mark.parametrize("name", ["e17_line_tokens", "c14_sheet_room_areas"])
def test_words_of_pages_are_not_moved(spark, name):
    """lines are dealt by order and items by sheet; words, lines and tokens stay where their page is."""
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("MapInArrow") == 1, plan
    moved = plan[: plan.rindex("Exchange")]
    assert "posexplode" not in plan[plan.index("Exchange") :] and "posexplode" in moved


def test_tokens_in_one_pass(spark):
    """those of a page at once are those of lines, then tokens; words without numbers for places, too."""
    words = pages(5) + [(9, k, "N", float("nan") if k % 3 else 1.0 * k, 5.0, 9.0, 12.0) for k in range(9)] + [(9, 20, "M", 1.0, float("nan"), 9.0, 12.0), (8, 0, "ALONE", 1.0, 1.0, 2.0, 2.0)]
    random.Random(2).shuffle(words)
    data = spark.createDataFrame(words, WORD)
    rows = lambda df: sorted(map(repr, df.collect()))
    apart, whole = layout.tokens(layout.lines(data)), layout.page_tokens(data)
    assert rows(whole) == rows(apart) == rows(layout.page_tokens(data.coalesce(1), dealt=True))
    assert rows(layout.room_areas(data)) == rows(layout.room_areas(data.coalesce(1), dealt=True)) and layout.page_tokens(data.limit(0)).collect() == []


def test_areas_look_at_names_near_them():
    """the time of a page follows its tokens; before, each area was compared with all names."""
    box = lambda text, x, y: {"text": text, "x_min": x, "y_min": y, "x_max": x + 40.0, "y_max": y + 10.0, "height": 10.0}
    page = [t for k in range(12_000) for t in (box(f"ROOM {chr(65 + k % 26)}", 0.0, 100.0 * k), box("9.50 m2", 0.0, 100.0 * k + 26.0))]
    began = time.time()
    assert [p[2] for p in layout.pairs(page)] == [26.0] * 12_000
    assert time.time() - began < 5

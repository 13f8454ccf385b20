"""Text operators against brute force, exact round trips and SQL, on small tables with nulls, ties and odd texts."""

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from planwright.llm import decontamination, html_text, jaccard, line_dedup, pii, quality, secrets, sentencepiece_lattice, sql, token_counts, warc
from planwright.llm.queries import BYTE_BPE_PATTERN, TOKENIZERS, _joined

LONG = " ".join(f"word{k % 977} Tail{k}" for k in range(6000))
BASE = " ".join(f"alpha{k}" for k in range(60))
TEXTS = [
    BASE, BASE, BASE.replace("alpha30", "beta"), BASE.upper() + " one", None, "", " \t\n ", "short text", "short text", "a b", LONG, LONG + " extra",
    "shared heading line\nfirst body of the text goes here\nshared heading line\n\nlast words", "Shared Heading Line  \nsecond body, quite different from it",
    "x y z w v x y z w v x y z w v", "héllo wörld ünd so weiter 日本語 text mit vielen wörtern drin hier", "*** ### <<< $$$", "line\n" * 50 + "end",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "host-a" if k % 3 else None, None if t is None else len(t), "extra") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string")


def duck_rows(query, docs, **more):
    con = duckdb.connect()
    frames = {"documents": docs.select("doc_id", "text", "source").toPandas()} | {k: v.toPandas() for k, v in more.items()}
    for name, frame in frames.items():
        con.register(f"_{name}", frame)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
    cursor = con.execute(query)
    return [c[0] for c in cursor.description], sorted(map(repr, cursor.fetchall()))


def same(df, columns, rows):
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.select(*columns).collect()) == rows


def test_decontamination(spark, docs):
    items = spark.createDataFrame([("i1", " ".join(f"ALPHA{k}" for k in range(5, 25)), 1), ("i2", "short text", 1), ("i3", None, 1), ("i4", "never seen anywhere", 1), ("i2", "short text", 1)],
                                  "item_id string, text string, doc_id int")
    out = decontamination.decontaminate(docs, items)
    out = out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
    same(out, *duck_rows(sql.OP1, docs, benchmark=items.select("item_id", "text")))


def test_quality_rules(docs):
    same(quality.quality_rules(docs), *duck_rows(sql.OP2, docs))


def test_frequent_lines_go(spark):
    rows = [(k, f"subscribe to our newsletter now\nbody {k} " + " ".join(f"w{k}_{j}" for j in range(20)), "h") for k in range(40)] + [(99, "subscribe to our newsletter now\nfew", "h")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    out = {r.doc_id: r for r in quality.quality_rules(docs, keep_text=True).collect()}
    assert all("newsletter" not in out[k].text and out[k].kept for k in range(40)) and not out[99].kept
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_frequent_longest_line(spark):
    """Different documents count although the shared line is the longest of each; copies of one text count once."""
    shared = " ".join(f"shared{j}" for j in range(60))
    body = lambda k: f"body {k} " + " ".join(f"w{k}_{j}" for j in range(20))
    rows = [(k, f"{shared}\nsign up here\n{body(k)}", "h") for k in range(40)] + [(100 + k, f"{shared}\nonly {k} left", "h") for k in range(40)]
    rows += [(200 + k, f"{shared} too\n{body(999)}", "h") for k in range(40)]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, source string"), keep_text=True).collect()}
    assert all(out[k].text == body(k) and out[k].n_removed_lines == 2 and out[k].kept for k in range(40))
    assert not any(out[100 + k].kept for k in range(40)) and all(out[200 + k].kept and out[200 + k].n_removed_lines == 0 for k in range(40))


def test_copies_count_if_asked(spark):
    """300 documents of a host, 15 texts: a shared line goes if copies count, and stays if each text counts once."""
    body = lambda k: " ".join(f"w{k}_{j}" for j in range(20))
    rows = [(k, f"sign up here\n{body(k % 15)}", "h") for k in range(300)] + [(1000, None, "h"), (1001, "", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    found = lambda **more: quality.quality_rules(docs, **more).agg(F.sum("n_removed_lines")).head()[0]
    assert found() == 0
    assert found(count_copies=True) == 300


def test_share_is_of_counted_texts(spark, monkeypatch):
    """Copies are in neither side of the share: a line of 30 of 60 texts goes, however many copies there are."""
    monkeypatch.setattr(quality, "LINE_SHARE", 0.4)
    body = lambda k: " ".join(f"w{k}_{j}" for j in range(20))
    rows = [(k, ("sign up here\n" if k < 30 else "") + body(k), "h") for k in range(60)] + [(100 + k, body(59), "h") for k in range(200)]
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, source string"))
    assert out.agg(F.sum("n_removed_lines")).head()[0] == 30


@pytest.mark.parametrize("name", ["frequent_lines", "line_removals"])
def test_texts_are_not_carried_along_lines(docs, name):
    """What is a document's own is made once, not for each of its lines: no text passes an explode()."""
    plan = getattr(quality, name)(docs.select("doc_id", "text", "source"))._jdf.queryExecution().optimizedPlan()
    nodes = plan.toString().splitlines()
    above = [x for k, node in enumerate(nodes) if "Generate " in node for x in nodes[max(0, k - 2):k]]
    assert above and not any(re.search(r"\btext#|split\(", x) for x in above)


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs).withColumn("kept_sha256", F.sha2(F.encode("kept_text", "UTF-8"), 256))
    same(out, *duck_rows(sql.OP4, docs))


def test_jaccard(docs):
    same(jaccard.near_duplicates(docs), *duck_rows(sql.ORACLE_SQL["op9_ngram_jaccard"], docs))


def test_jaccard_null_id_without_words(spark):
    rows = [(None, BASE), (None, BASE + " one"), (None, ""), (None, None), (None, " \t "), (7, BASE + " two"), (8, "far from all the others")]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(None, 57, None), (None, 58, None)] + [(None, 0, None)] * 3 + [(7, 58, None), (8, 2, 8)], key=repr)


def test_jaccard_crowd(spark, monkeypatch):
    """A group of near copies of which no two hubs are alike goes through the hub rounds and loses no link."""
    import random

    monkeypatch.setattr(jaccard, "CROWD", 3)
    rng, base = random.Random(5), [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        text = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 1, 2])):
            text[at] = f"new{k}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.lit("s"))
    same(jaccard.near_duplicates(docs), *duck_rows(sql.ORACLE_SQL["op9_ngram_jaccard"], docs))


@pytest.mark.parametrize("held", [250_000, 60])
def test_components_of_long_paths(spark, monkeypatch, held):
    """Paths through nodes in mixed order: put together in a task, or in several with rounds between them."""
    import random

    monkeypatch.setattr(jaccard, "TASK_LINKS", held)
    rng, nodes = random.Random(3), list(range(-500, 500))
    rng.shuffle(nodes)
    paths = [nodes[:400], nodes[400:700], nodes[700:702]]
    links = spark.createDataFrame([rng.choice([(a, b), (b, a)]) for p in paths for a, b in zip(p, p[1:], strict=False)] + [(nodes[0], nodes[0])], "u bigint, v bigint")
    spark.sparkContext.setJobGroup(f"paths-{held}", "")
    found = {r.node: r.comp for r in jaccard.components(links).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {n: min(p) for p in paths for n in p}
    if held > 1000:
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"paths-{held}")) <= 12


KINDS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
         ("hex", re.compile("[0-9a-f]+"), 0, 24), ("pem", re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1),
         ("jwt", re.compile(r"(?<![\w-])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}", re.A), 0, 1), ("login", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{1,64}@", re.A), 0, 1)]


def spans_of(text, kinds):
    want = sorted((m.start(), rank, m.end(), kind) for rank, (kind, p, g, least) in enumerate(kinds) for m in p.finditer(text or "") if len(m[g]) >= least)
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)


def test_secrets(spark):
    texts = ["api_key = 'abcdef123' and token: x", "ü日 PASSWORD=hunter22222 AKIA" + "A1" * 10, "f" * 30 + " " + "e" * 23, None, "", "ü日 PASSWORD=hunter22222 AKIA" + "A1" * 10]
    rows = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "path int, version int, text string")
    ledger = secrets.update_ledger(rows)
    out = {r.path: r.s for r in secrets.findings(rows, ledger).select("path", _joined(F.filter("spans", lambda s: s["rank"] < 3)).alias("s")).collect()}
    assert out == {k: spans_of(text, KINDS[:3]) for k, text in enumerate(texts)}
    assert ledger.count() == len({t or "" for t in texts}) and secrets.update_ledger(rows, ledger).count() == 0


def test_secrets_of_all_kinds(spark):
    """All six kinds, more matches than are placed together, a long run of token heads, an empty table and clashing columns."""
    texts = [
        "-----BEGIN RSA PRIVATE KEY-----\nx eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh_-1 ftp://jo:pw@host/ üeyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh1 xeyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh1",
        " ".join(f"日 token=abc{k:04d} {'f' * 24} pw: token=ab" for k in range(700)), "eyJaaaaaaaa" * 20000, "eyJaaaaaaaa." * 3000, "AKIA" * 50000, None, "",
    ]
    rows = spark.createDataFrame([(k, 1, t, "x", "y") for k, t in enumerate(texts)], "path int, version int, text string, spans string, blob string")
    ledger = secrets.update_ledger(rows)
    out = {r.path: r.s for r in secrets.findings(rows, ledger).select("path", _joined(F.col("spans")).alias("s")).collect()}
    assert out == {k: spans_of(text, KINDS) for k, text in enumerate(texts)}
    assert secrets.update_ledger(rows.limit(0)).count() == 0 and secrets.findings(rows.limit(0), ledger).count() == 0


def test_secret_ledger_rounds(spark, monkeypatch):
    """A later round scans unseen blobs alone; with other rules every blob is scanned again, old versions included."""
    first = spark.createDataFrame([(1, 1, "token=abcdef1"), (2, 1, "plain")], "path int, version int, text string")
    later = first.unionByName(spark.createDataFrame([(1, 2, "token=abcdef2"), (3, 1, "plain")], first.schema))
    known = secrets.update_ledger(first)
    new = secrets.update_ledger(later, known)
    assert (known.count(), new.count()) == (2, 1)
    found = {(r.path, r.version): r.s for r in secrets.findings(later, known.unionByName(new)).select("path", "version", _joined(F.col("spans")).alias("s")).collect()}
    assert found == {(1, 1): "assign:0:13", (1, 2): "assign:0:13", (2, 1): "", (3, 1): ""}
    ledger = known.unionByName(new)
    monkeypatch.setattr(secrets, "RULE_VERSION", "2")
    assert secrets.update_ledger(later, ledger).count() == 3


def test_token_counts(docs):
    vocabulary = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    counter = token_counts.Counter(vocabulary, BYTE_BPE_PATTERN)
    trees = token_counts.with_trees(docs, vocabulary, BYTE_BPE_PATTERN)
    edits = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(s).alias("seq"), F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(n).alias("new")) for s, a, b, n in [(0, 3, 9, "  'll x"), (1, 0, 2, ""), (2, 50, 50, "\n\n 12")]])).alias("e")).select("doc_id", "e.*")
    for r in token_counts.recount(trees, edits, vocabulary, BYTE_BPE_PATTERN).collect():
        text = TEXTS[r.doc_id] or ""
        for a, b, new in [(3, 9, "  'll x"), (0, 2, ""), (50, 50, "\n\n 12")]:
            text = text[: min(a, len(text))] + new + text[max(min(a, len(text)), min(b, len(text))) :]
        assert r.text == text and r.n_tokens == len(counter.encode(text)) == r.tree[0] == sum(r.leaf_tokens)


def test_sentencepiece_fold_of_many_words(spark, monkeypatch):
    """Each word as by merges with a heap, in folds of a few edges; edges are neither grouped as objects nor words sorted to be joined."""
    import random

    monkeypatch.setattr(sentencepiece_lattice, "EDGES_HELD", 50)
    pieces = sentencepiece_lattice.piece_rows(f"{TOKENIZERS}/piece_bpe_32k.model")
    table, rng = sentencepiece_lattice.PieceTable(pieces), random.Random(8)
    words = ["".join(rng.choice("▁aeinorstthue\u0301é日\U0001f600\x01") for _ in range(rng.choice([1, 2, 5, 9, 20, 60, 61, 75]))) for _ in range(300)]
    dealt = spark.createDataFrame([(w,) for w in words], "word string").repartition(3, "word")
    found = sentencepiece_lattice.with_ids(dealt, sentencepiece_lattice.word_ids(dealt, pieces))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "ObjectHashAggregate" not in plan
    rows = found.collect()
    assert sorted(r.word for r in rows) == sorted(words)
    for r in rows:
        assert r.ids == sentencepiece_lattice._ids_of(table, sentencepiece_lattice.merge_one(table, r.word)), r.word


def test_sentencepiece(docs):
    import sentencepiece

    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    pieces = sentencepiece_lattice.piece_rows(model)
    rows = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, pieces), pieces).collect()
    real = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in rows:
        assert r.ids == real.encode(r.text or "") and r.decoded == (r.text or "") and r.n_words == "extra"


def test_viterbi(spark):
    pieces = spark.createDataFrame([("a", -1.0), ("b", -1.0), ("ab", -1.5), ("aba", -4.0)], "piece string, score double")
    out = {r.word: r.path for r in sentencepiece_lattice.viterbi_words(spark, spark.createDataFrame([("aba",), ("abz",), ("",), (None,)], "word string"), pieces).collect()}
    assert out == {"aba": ["ab", "a"], "abz": None, "": [], None: None}


def test_warc(spark, tmp_path):
    big = "<p>ü</p>" * 300
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3", "small"), (4, "http://a/4", "small"), (None, "http://a/n", None), (5, "http://a/5\r\nX: y", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("shard", F.lit("clash"))
    path = f"{tmp_path}/manifest"
    warc.write_shards(pages, f"file://{tmp_path}/w", roll_bytes=500).write.parquet(path)
    manifest = spark.read.parquet(path)
    out = {r.page_id: r for r in warc.read_shards(manifest, f"file://{tmp_path}/w").collect()}
    assert {k: r.refers_to for k, r in out.items()} == {1: 5, 2: 5, 3: None, 4: None, None: None, 5: None}
    assert out[5].payload == big and out[None].payload == "" and out[1].payload is None and out[1].payload_bytes == len(big.encode())
    assert manifest.count() > 1


def test_pii(spark):
    texts = ["mail jo.doe@site.org or 192.168.1.20 on 2021-03-04", "again jo.doe@site.org, card 4111 1111 1111 1111, iban DE89370400440532013000", None, "", "no data, 1999-13-40 is no date"]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, kind string")
    out = {r.doc_id: r for r in pii.pseudonymise(rows, "k").collect()}
    mail = [re.search(r"\S+@site\.org", out[k].text)[0] for k in (0, 1)]
    assert mail[0] == mail[1] != "jo.doe@site.org" and re.fullmatch(r"[a-z]{2}\.[a-z]{3}@site\.org", mail[0])
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", out[1].text)[0].replace(" ", "")
    assert card != "4111111111111111" and sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(card)) % 10 == 0
    iban = re.search(r"DE\d{20}", out[1].text)[0]
    assert iban != "DE89370400440532013000" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert out[2].text is None and out[3].text == "" and out[4].text == texts[4] and [x.kind for x in out[0].pii] == ["email", "ip", "date"]


def test_pii_phones(spark):
    phones = ["+1 (017) 555-7713", "+1 (132) 555-1352", "+1 (232) 555-1352", "(017) 555-7713", "1-212-555-0123", "212.555.0123", "+1 017 555 7713", "+1.132.555.1352",
              "+12125550123", "+44 (20) 7946 0958", "+44 (0)20 7946 0958", "+49(30)123456", "+44 20 7946 0958"]
    plain = ["017-555-7713", "+5 (3) 12", "f(123) 4567", "+1 000 000"]
    rows = spark.createDataFrame([(k, f"call {p}, or not") for k, p in enumerate(phones + plain)], "doc_id int, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(rows, "k").collect()}
    for k, phone in enumerate(phones):
        new = out[k].text.removeprefix("call ").removesuffix(", or not")
        assert new != phone and re.sub(r"\d", "d", new) == re.sub(r"\d", "d", phone), phone
        assert [(x.kind, x.n) for x in out[k].pii] == [("intl" if phone.startswith("+4") else "phone", 1)], phone
    assert [out[len(phones) + k].text for k in range(len(plain))] == [f"call {p}, or not" for p in plain]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="no driver's tables")
def test_pii_phones_of_documents(spark):
    """Every phone-shaped number of the driver's documents is found, whatever its area code."""
    shape = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\) ?\d{3,4}[ .-]\d{4}(?!\d)"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").rlike(shape)).select("doc_id", "text")
    out = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    numbers = [(r.doc_id, n) for r in docs.collect() for n in re.findall(shape, r.text)]
    assert numbers and not [(k, n) for k, n in numbers if n in out[k].text]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Head &amp; more</h1><p>One  two\n three</p><aside>ad</aside><script>x()</script></article><footer>f</footer></body></html>"
    plain = "<div>site name</div><p>story {0} one</p><p>story {0} two</p><div>legal line</div>"
    rows = [(1, "http://a/x", page), (2, "http://b/p/1", plain.format("a")), (3, "http://b/p/2", plain.format("b")), (4, None, None), (5, "http://c/", "")]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out == {1: "Head & more\n\nOne two three", 2: "story a one\n\nstory a two", 3: "story b one\n\nstory b two", 4: "", 5: ""}

"""The engine's operators on the cases of the survey, and every registered query against its SQL."""

import io
import os
import re
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from docflow.functions import text as X
from docflow.operators import checks, correct, glossary, html, quality, segment, store, translate
from docflow.plans.oracle import ORACLE_SQL
from docflow.plans.queries import QUERIES
from docflow.sources import epub, stores

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "conversations", "pages"]


def value(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("v")).first()["v"]


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(norm([r[c] for c in columns]) for r in df.collect())
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(norm([row[names.index(c)] for c in columns]) for row in result.fetchall())


@pytest.mark.parametrize("a,b,want", [(" text", "texte", " texte"), ("text ", "texte", "texte "), ("   text", "texte", " texte"), (" text ", " texte ", " texte "), ("", "texte", "texte"), ("\ntext", "texte", " texte"), ("a", "", "")])
def test_edge_space(spark, a, b, want):
    assert value(spark, X.edge_space(F.col("a"), F.col("b")), a=a, b=b) == want
    assert html.with_edges(a, b) == want


def test_scalars(spark):
    assert value(spark, X.fragment_text(F.col("a")), a=["start ", " middle ", " end"]) == "start </> middle </> end"
    assert value(spark, X.quote_pairs(F.col("a")), a="“A,” he said, “B”") == 2
    assert value(spark, X.quote_pairs(F.col("a")), a='"A"') == 0
    assert value(spark, X.separators(F.col("a")), a="A</>B</>C</>D") == 3
    assert value(spark, X.terms(F.col("a")), a="Dr. Sakamoto activated the DNA MatrixCore. Then") == ["DNA", "MatrixCore", "Sakamoto", "Then"]
    assert value(spark, X.proper_nouns(F.col("a")), a="The man met John Smith and NASA. Later Tom left") == ["John Smith", "NASA", "Tom"]
    assert value(spark, X.cache_key(F.col("a")), a="path/to:test.html").startswith("path_totest.html_")
    assert value(spark, X.english_score(F.col("a")), a="The cat is sleeping on the couch.") >= 0.6
    assert value(spark, X.english_score(F.col("a")), a="Le chat dort sur le canapé.") < 0.6
    for word, out in (("the", True), ("I", True), ("a", True), ("am", True), ("Dr", False), ("AA", False), ("Matrix", False)):
        assert value(spark, X.is_excluded(F.col("a")), a=word) is out
    assert value(spark, X.is_extraction_error(F.col("a"), F.col("b")), a="after", b="Flio") is True
    assert value(spark, X.is_extraction_error(F.col("a"), F.col("b")), a="Matrix", b="Matrice") is False


def test_nulls_pass_through(spark):
    for e in (X.collapse, X.comparison_key, X.cache_key, X.separators, X.quote_pairs, X.sentences, X.terms):
        assert value(spark, e(F.col("a")), a=None) is None


def test_parser(spark):
    raws = [
        (1, "<0/>Bonjour\n<1/>Monde\n<2/>Test\n[=[END]=]"), (2, "<0/>Hello</>World\n<1/>Foo</>Bar</>Baz\n[=[END]=]"), (3, "<0/>First line\nSecond\n<1/>Another\n[=[END]=]"),
        (4, "<0/>no end"), (5, "[ERREUR: x"), (6, "nothing\n[=[END]=]"), (7, "<0/>a\n<0/>b\n[=[END]=]"), (8, "\n\t<0/> a\t\n<1/>\tb \u00a0\n[=[END]=]\r\n"), (9, " \n[ERREUR: y"),
        (10, "<0/>a [=[END]=]\n<1/>b\n[=[END]=]\n"), (11, None), (12, ""), (13, "[=[END]=]"),
    ]
    df = spark.createDataFrame(raws, "doc_id long, raw string")
    got = {}
    for r in checks.parse_output(df).collect():
        got.setdefault(r["doc_id"], {})[r["line_idx"]] = r["text"]
    assert got == {1: {0: "Bonjour", 1: "Monde", 2: "Test"}, 2: {0: "Hello</>World", 1: "Foo</>Bar</>Baz"}, 3: {0: "First line", 1: "Another"}, 7: {0: "b"}, 8: {0: "a", 1: "b"}, 10: {0: "a", 1: "b"}}
    said = [r["s"] for r in df.orderBy("doc_id").select(checks.status(F.col("raw")).alias("s")).collect()]
    assert said[:10] == ["ok", "ok", "ok", "missing_end", "error", "no_lines", "ok", "ok", "error", "ok"] and said[11:] == ["missing_end", "no_lines"]
    from docflow.functions import protocol

    for doc, raw in raws:
        if raw is not None:
            try:
                assert protocol.parse(raw) == got[doc]
            except ValueError as e:
                assert str(e) == said[doc - 1] and doc not in got


def pairs(spark, rows):
    return spark.createDataFrame([(1, i, 31 + i, a, b) for i, (a, b) in enumerate(rows)], "doc_id long, pos long, h long, original string, translated string")


def test_quarantine(spark):
    rows = [(f"line {i}" if i != 2 else "a</>b", f"ligne {i}") for i in range(10)]
    rows[3], rows[7] = (rows[3][0], None), (rows[7][0], None)
    df = pairs(spark, rows)
    held = {r["chunk_line"]: r["check_name"] for r in checks.quarantine(df).collect()}
    assert held == {2: "fragment_count", 3: "line_count", 7: "line_count"}
    assert [tuple(r) for r in checks.validation_stats(df).collect()] == [("partial", 1)]
    assert checks.line_count_errors(df).first()["missing"] == "3,7"
    assert checks.line_count_errors(df, strict_keys=True).count() == 1


def test_index_check(spark):
    def run(asked, came):
        e, r = (spark.createDataFrame([(1, i) for i in x] or [(2, 0)], "doc_id long, pos long") for x in (asked, came))
        return next(tuple(x)[1:] for x in checks.index_check(e, r).collect() if x["doc_id"] == 1)

    assert run([1, 2, 3], [3, 2, 1]) == (True, "", "")
    assert run([1, 2, 3], [1, 5]) == (False, "2,3", "5")
    assert run(range(30), [40]) == (False, ",".join(map(str, range(20))), "40")


def test_segmentation(spark):
    tok = [120, 40, 30, 20, 50, 60, 10, 90, 5]
    df = spark.createDataFrame([(1, i, "x" * (4 * n)) for i, n in enumerate(tok)], "doc_id long, pos long, text string")
    rows = segment.body(df, 100)
    assert [r["chunk_id"] for r in rows.orderBy("seq").collect()] == [1, 2, 2, 2, 3, 4, 4, 5, 5]
    text = segment.prompts(segment.members(rows, 100, 0.15)).where("chunk_id = 2").first()["prompt"]
    assert text.startswith("<0/>") and text.count("/>") == 3
    marked = segment.prompts(segment.members(rows, 100, 0.0), F.col("i").isin(1, 3)).where("chunk_id = 2").first()["prompt"]
    assert marked.count("/>") == 1 and "<1/>" in marked


def test_store(spark):
    w = spark.createDataFrame([("initial", "a.html", "2", "x", 1), ("initial", "a.html", "2", "y", 2), ("initial", "a.html", "10", "z", 1), ("initial", "a.html", "t1", 'q"é', 1), ("refined", "a.html", "2", "", 1)], "phase string, source_file string, line_index string, text string, write_seq int")
    import tempfile

    path = tempfile.mkdtemp() + "/store"
    stores.write_store(w, path)
    assert [(r["line_index"], r["text"]) for r in stores.read_store(spark, path, "initial").collect()] == [("2", "y"), ("10", "z"), ("t1", 'q"é')]
    row = stores.json_store(stores.read_store(spark, path, "initial")).first()
    assert row["value"] == '{"2": "y", "10": "z", "t1": "q\\"é"}'
    keyed = [spark.read.parquet(path).where(F.col("phase") == p).select(F.col("line_index").alias("key"), "text") for p in ("initial", "refined")]
    got = {r["key"]: (r["text"], r["origin"]) for r in store.fallback(*keyed).collect()}
    assert got["2"] == ("y", "initial")
    (tmp := open(path + ".json", "w")).write("{ invalid json }")
    tmp.close()
    rows, damaged = stores.read_json_store(spark, path + ".json")
    assert rows.count() == 0 and damaged.first()["value"] == "{ invalid json }"
    stores.set_aside(damaged, path + "-aside")
    assert spark.read.parquet(path + "-aside").first()["backup"].endswith(".json.backup")
    stores.clear_store(spark, path, source_file="a.html", phase="refined")
    assert spark.read.parquet(path).where("phase = 'refined'").count() == 0 and spark.read.parquet(path).count() == 3
    stores.clear_store(spark, path)
    assert spark.read.schema("source_file string, line_index string, text string").parquet(path).count() == 0


def test_json_store_files(spark, tmp_path):
    """Files do not grow with the sources; a source written again is replaced as a whole, the others stay, and what is damaged is told."""
    path = f"file://{tmp_path}/store"
    kind = "source_file string, line_index string, text string"
    odd = 'a\t"b\n\u2028c'
    stores.write_json_store(spark.range(300).selectExpr("concat('d/', id) AS source_file", "'0' AS line_index", "concat('t', id) AS text"), path)
    assert len([f for _, _, files in os.walk(tmp_path) for f in files if f.startswith("part-")]) <= 8
    stores.write_json_store(spark.createDataFrame([("d/1", "5", odd), (odd, "k", ""), (odd, "2", "\\")], kind), path)
    name = lambda source: value(spark, X.cache_key(F.col("a")), a=source)
    rows, damaged = stores.read_json_store(spark, path)
    got = {(r["source_file"], r["line_index"]): r["text"] for r in rows.collect()}
    assert got == {(name(f"d/{i}"), "0"): f"t{i}" for i in range(300) if i != 1} | {(name("d/1"), "5"): odd, (name(odd), "k"): "", (name(odd), "2"): "\\"}
    assert damaged.count() == 0
    (tmp_path / "store" / "write=2" / "part-x.txt").write_text('{"cut.json": {"0": "a\n')
    rows, damaged = stores.read_json_store(spark, path)
    assert rows.count() == 302 and [r["value"] for r in damaged.collect()] == ['{"cut.json": {"0": "a']


def test_headings_cut_within_a_reference(spark, tmp_path):
    made = ["a &amp; b&amp", "&amp;&am", "x &lt;&", "&amp;lt; &quot;c&quot;&quot", "&copy; &#38;", "plain"]
    spark.createDataFrame(list(enumerate(f"<html><body><h1>{t}</h1><p>&copy</p></body></html>" for t in made)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in QUERIES["html_headings"](spark, f"file://{tmp_path}").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(ORACLE_SQL["html_headings"]).fetchall()) and got[0] == "a & b&amp" and len(got) == len(made)
    assert html.page_fragments("<h1>b&amp</h1>") == [(1, "h1", 1, "b&")]


def test_alignment_of_a_long_line(spark):
    """A line of 2000 terms and candidates, as quickly as sums for each two allow; terms that punctuation breaks are in no place."""
    import time

    word = lambda i, a: "".join(chr(97 + int(d)) for d in f"{i * 7919 % 10_007}").capitalize() + a
    original = " ".join(["So", *(word(i, "ex") for i in range(2000)), "Ab-cd"])
    translated = " ".join(["Si", *(word(i, "ov") for i in reversed(range(2000))), "Ef-gh"])
    began = time.monotonic()
    got = {r["source"]: (r["target"], r["score"]) for r in glossary.align(spark.createDataFrame([(1, original, translated), (2, None, "A"), (3, "No Way", None)], "pair_id long, original string, translated string")).collect()}
    assert time.monotonic() - began < 60
    candidates = sorted({w.replace("-", "") for w in translated.split()})

    def score(s, c):
        at = translated.find(c)
        near = 0.0 if at < 0 else (1.0 - abs(original.find(s) / len(original) - at / len(translated))) * 2.0
        return near + min(len(s), len(c)) / max(len(s), len(c)) + (0.5 if s[0] == c[0] else 0.0)

    assert len(got) == 2002
    for s in ("So", "Abcd", *(word(i, "ex") for i in range(0, 2000, 97))):
        best = max(candidates, key=lambda c: score(s, c))
        assert got[s] == (best, score(s, best))


def test_glossary(spark):
    obs = spark.createDataFrame([("Matrix", "Matrice", i) for i in range(3)] + [("Matrix", "Système", 9), ("Ahh", "Aah", 10), ("Ahh", "Oh", 11), ("the", "Le", 12), ("Rare", "Rare", 13)], "source string, target string, seq long")
    counted = glossary.counts(obs)
    assert {r["source"]: r["target"] for r in glossary.translations(counted).collect()} == {"Matrix": "Matrice", "Ahh": "Aah", "Rare": "Rare"}
    clash = glossary.conflicts(counted)
    assert [(r["source"], r["targets"]) for r in clash.collect()] == [("Ahh", ["Aah", "Oh"])]
    assert [tuple(r) for r in glossary.categorised(clash).collect()] == [("Ahh", "onomatopoeia", "low")]
    assert {r["source"]: r["status"] for r in glossary.cleaned(obs).collect()} == {"Matrix": "kept", "Ahh": "kept", "the": "stopword", "Rare": "low_confidence"}
    fixed = spark.createDataFrame([("Matrix", "Grille")], "source string, target string")
    assert {r["source"]: r["target"] for r in glossary.translations(counted, fixed).collect()}["Matrix"] == "Grille"
    assert glossary.export(counted).first()["prompt"].startswith("Matrix → Matrice, Ahh → Aah")
    again, _ = stores.read_glossary(spark, stores.glossary_json(counted, fixed))
    assert sorted((r["source"], r["target"], r["cnt"]) for r in again.collect()) == sorted((r["source"], r["target"], r["cnt"]) for r in counted.collect())
    assert stores.read_glossary(spark, "{ bad")[0].count() == 0


def test_quality(spark):
    texts = spark.createDataFrame([(1, "The cat is sleeping on the couch. Le chat dort."), (2, None)], "doc_id long, text string")
    assert [r["position"] for r in quality.untranslated(texts).collect()] == [0]
    same = spark.createDataFrame([("a", "Hello world", "hello, world"), ("b", "Hello world", "Bonjour le monde"), ("c", None, "x")], "key string, original string, translated string")
    assert [tuple(r) for r in quality.copies(same).collect()] == [("a", 1.0, "identical")]
    obs = spark.createDataFrame([("Matrix", "Matrice", 0), ("Matrix", "Matrice", 1), ("Matrix", "Système", 2), ("X", "X", 3)], "source string, target string, seq long")
    assert [tuple(r) for r in quality.terminology_issues(obs).collect()] == [("Matrix", 2, 0.7, "Matrice")]


def test_html(spark):
    page = "<html><body><p>start <b> middle</b></p><div>loose</div><h1>T &amp; U</h1><script>x</script><!-- c --></body></html>"
    assert html.page_fragments(page) == [(1, "p", 2, "start </> middle"), (3, "h1", 1, "T & U")]
    done, n = html.rewrite("<p><b>start <em>middle</em> end</b></p>", {1: "début</>milieu</>fin"}, "replace")
    assert (done, n) == ("<p><b>début <em>milieu</em> fin</b></p>", 1)
    done, _ = html.rewrite("<p>one</p>", {1: "un"}, "separate")
    assert done == '<p class="original" style="color: #9ca3af;">one</p><p class="translation" lang="translated">un</p>'
    with pytest.raises(html.FragmentMismatch):
        html.rewrite("<p>a<b>b</b></p>", {1: "x"})
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert html.fragments(df).count() == 2 and html.rewrite_pages(df, html.fragments(df).select("page_id", "frag_index", F.upper("text").alias("text"))).count() == 3


def test_epub_round_trip(spark):
    book = epub.Book("id1", "Title & more", "en", ["A", "B"], [("c2", "two.xhtml", "application/xhtml+xml", b"<p>2</p>"), ("c1", "one.xhtml", "application/xhtml+xml", b"<p>1</p>"), ("s", "s.css", "text/css", b"p{}")], ["c1", "c2"])
    files = spark.createDataFrame([("b.epub", epub.write_book(book))], "path string, content binary")
    rows = epub.items(files)
    assert [r["item_id"] for r in epub.documents_in_spine_order(rows).collect()] == ["c1", "c2"]
    assert [r["item_id"] for r in epub.resources(rows).collect()] == ["s"]
    meta = epub.translated_metadata(epub.metadata(files), "fr")
    data = bytes(epub.archives(meta, rows).first()["content"])
    again = epub.read_book(data)
    assert (again.title, again.language, again.spine, again.creators) == ("Title & more (fr)", "fr", ["c1", "c2"], ["A", "B"])
    assert zipfile.ZipFile(io.BytesIO(data)).namelist()[0] == "mimetype"


def test_translator_and_repair(spark):
    calls = []

    def flaky(prompt, reasoning):
        calls.append(reasoning)
        if len(calls) < 3:
            raise TimeoutError("slow")
        return "ok"

    assert translate.call(flaky, "x", base=0) == ("ok", 3) and calls == [False, False, True]
    assert translate.call(lambda p, r: (_ for _ in ()).throw(ConnectionError("limit")), "x", base=0)[0].startswith("[ERREUR")
    assert [translate.backoff("timeout", n) for n in range(3)] == [1, 2, 4] and [translate.backoff("rate", n) for n in range(3)] == [1, 3, 9]
    df = pairs(spark, [("a</>b", "x"), ("c", None), ("d", "D")])
    fixed = {r["pos"]: r["translated"] for r in translate.repair(df, translate.mock).collect()}
    assert fixed == {0: "A</>B", 1: "C", 2: "D"}


def counting(path, answer):
    """A translator that leaves a file for each call, to be counted whatever process made it."""
    import uuid

    def ask(prompt, reasoning=False):
        (path / uuid.uuid4().hex).write_text(f"{int(reasoning)} {prompt}")
        return answer(prompt, reasoning)

    return ask, lambda: sorted(p.read_text() for p in path.iterdir())


END = "[=[END]=]"


def test_only_flagged_lines_are_asked_for(spark, tmp_path):
    df = pairs(spark, [(f"line {i}", f"ligne {i}") for i in range(20)] + [("a</>b", "ab")])
    ask, calls = counting(tmp_path, lambda p, r: f"x</>y\n{END}")
    kept, bad = correct.run(df, ask)
    assert kept.count() == 21 and bad.count() == 0 and len(calls()) == 1
    assert "exactly 1 separators at the same places" in calls()[0] and "Before, with 0: ab" in calls()[0]


def test_missing_lines_are_asked_for_together(spark, tmp_path):
    rows = [(f"line {i}", None if i in (3, 7) else f"ligne {i}") for i in range(10)]
    ask, calls = counting(tmp_path, lambda p, r: f"<3/>trois\n<7/>sept\n{END}" if r else f"<3/>trois\n{END}")
    kept, bad = correct.run(pairs(spark, rows), ask)
    got = {r["pos"]: (r["translated"], r["attempts"]) for r in kept.collect()}
    assert got[3] == ("trois", 2) and got[7] == ("sept", 2) and got[0] == ("ligne 0", 0) and bad.count() == 0
    assert [c[0] for c in calls()] == ["0", "1"] and "missing: 3, 7." in calls()[0] and "<3/>line 3" in calls()[0] and "<4/>" not in calls()[0] and "line 4" in calls()[0]


def test_the_failing_check_decides(spark, tmp_path):
    rows = [("x “q” y", "x q y"), ("a</>b</>c", "abc"), ("d", None), ("e", "E")]
    ask, calls = counting(tmp_path, lambda p, r: f"x y\n{END}")
    kept, bad = correct.run(pairs(spark, rows), ask)
    assert [r["pos"] for r in kept.collect()] == [3]
    assert {r["chunk_line"]: (r["check_name"], r["translated_text"], r["reason"]) for r in bad.collect()} == {
        0: ("punctuation", "x q y", "punctuation: expected 1, got 0"), 1: ("fragment_count", "abc", "fragment_count: expected 3, got 1"), 2: ("line_count", "", "line_count: expected 1, got 0"),
    }
    said = calls()
    assert len(said) == 2 + 2 + 3 and sum("anywhere" in c or "wherever" in c for c in said) == 1
    assert sorted(c[0] for c in said) == list("0000111")


def test_a_model_that_raises_is_a_failed_attempt(spark, tmp_path):
    def answer(prompt, reasoning):
        if not reasoning:
            raise RuntimeError("down")
        return f"“q”\n{END}"

    ask, calls = counting(tmp_path, answer)
    kept, _ = correct.run(pairs(spark, [("“a”", "b")]), ask)
    assert kept.first()["translated"] == "“q”" and kept.first()["attempts"] == 2 and len(calls()) == 2


def test_a_check_of_ones_own(spark):
    digits = checks.Check("digits", lambda o, t: (F.char_length(F.regexp_replace(o, "[^0-9]", "")), F.char_length(F.regexp_replace(t, "[^0-9]", ""))))
    df = pairs(spark, [("a 1", "b 2"), ("a 12", "b 1"), ("c", None)])
    assert [(r["pos"], r["expected"], r["actual"]) for r in checks.validate_only(df, [digits]).collect()] == [(1, 2, 1)]
    mends = {"digits": lambda rows, ask, wording: rows.where("pos = 1").selectExpr("doc_id", "pos", "original AS new", "1 AS attempts")}
    kept, bad = correct.run(df, lambda p, r: "", [digits], mends=mends)
    assert {r["pos"]: r["translated"] for r in kept.collect()} == {0: "b 2", 1: "a 12", 2: None} and bad.count() == 0
    kept, bad = correct.run(df, lambda p, r: "", [digits], mends={})
    assert kept.count() == 2 and bad.first()["check_name"] == "digits"


def test_clients_and_keys(spark, monkeypatch):
    sent = []
    client = translate.ChatClient(lambda body: sent.append(body) or "", "be brief")
    assert client("hi") == "Result Empty" and client("hi", True) == "Result Empty"
    assert [b["model"] for b in sent] == ["chat", "reasoner"] and sent[0]["messages"][0]["content"] == "be brief" and sent[0]["max_tokens"] == 4000
    monkeypatch.delenv("API_KEY", raising=False)
    with pytest.raises(ValueError):
        translate.api_key(spark)
    monkeypatch.setenv("API_KEY", "k")
    assert translate.api_key(spark) == "k"
    with pytest.raises(AttributeError):
        translate.Settings().tries = 5


def test_session_logs(tmp_path):
    from datetime import datetime

    from docflow.sources.logs import Session

    session = Session(tmp_path, datetime(2024, 1, 2, 3, 4, 5))
    log = session.logger("a")
    assert not session.folder.exists() and log is session.logger("a")
    log.info("said")
    assert session.folder.name == "run_20240102_030405" and "INFO said" in (session.folder / "translation.log").read_text()
    for h in list(log.handlers):
        h.close()


def test_templates_from_a_folder(spark, tmp_path):
    from docflow.functions import prompts

    (tmp_path / "quotes.txt").write_text("Quote {expected} in {original}!")
    wording = prompts.Templates.from_folder(tmp_path)
    assert value(spark, prompts.retry_quotes(F.col("a"), F.lit(2), wording=wording), a="x") == "Quote 2 in x!"
    assert wording.refine == prompts.WORDING.refine and "into fr" in value(spark, prompts.first_pass("fr"), a="x")
    with pytest.raises(KeyError):
        prompts.render("{what}")


def test_tokenizer_measure(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    rows = [(1, 0, "some words here"), (1, 1, ""), (1, 2, "Ünïcödé")]
    got = segment.body(spark.createDataFrame(rows, "doc_id long, pos long, text string"), 100, X.tokenizer_tokens(path)).orderBy("seq").collect()
    assert [r["tok"] for r in got] == [max(1, len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)) for _, _, t in rows]


def test_report_text(spark):
    verdicts = spark.createDataFrame([("a", 2, True, False), ("b", 0, False, True)], "key string, n_untranslated long, is_copy boolean, ok boolean")
    issues = spark.createDataFrame([(f"S{i:02}", 2, 0.7 + i / 100, "T") for i in range(12)], "source string, n_targets long, confidence double, suggestion string")
    conflicts = spark.createDataFrame([("Ahh", ["Aah", "Oh"])], "source string, targets array<string>")
    stats = spark.createDataFrame([("total_terms", 5)], "metric string, value long")
    text = quality.report_text(verdicts, issues, conflicts, stats)
    assert "untranslated: 3" in text and "terminology_issues: 12" in text and "total_terms: 5" in text and "  and 2 more" in text and "Ahh: Aah, Oh" in text
    assert "S11: 2 targets" in text and "S00:" not in text
    assert quality.report_text(verdicts.limit(0), issues.limit(0), conflicts.limit(0), stats).endswith("no issues")


def test_pair_validation_flag(spark):
    df = spark.createDataFrame([("a", "x", "It is the one that they have and you will like it."), ("b", "Bonjour", "Bonjour"), ("c", "x", None)], "key string, original string, translated string")
    got = {r["key"]: (r["n_untranslated"], r["is_copy"], r["ok"]) for r in quality.pair_validation(df).collect()}
    assert got == {"a": (1, False, False), "b": (0, True, False), "c": (0, False, True)}
    assert quality.pair_validation(df, untranslated_check=False).where("ok").count() == 3


def test_context_of_long_books_is_that_of_all_pairs(spark):
    r = __import__("random").Random(5)
    tok = [r.randint(1, 130) for _ in range(300)]
    df = spark.createDataFrame([(1, i, "x" * (4 * n)) for i, n in enumerate(tok)], "doc_id long, pos long, text string")
    rows = segment.body(df, 100)
    held = [(r["seq"], r["chunk_id"], r["before"], r["tok"]) for r in rows.orderBy("seq").collect()]
    first = {}
    for seq, chunk, before, n in held:
        first.setdefault(chunk, (seq, before, before + n))
    for budget in (0, 15, 100, 1000):
        want = {(k - 1, seq) for k, (s, _, p1) in first.items() if k >= 1 for seq, _, before, _ in held if seq > s and before - p1 < budget}
        assert {(r["chunk_id"], r["seq"]) for r in segment.tail(rows, budget).collect()} == want
        want = {(k, seq) for k, (s, p, p1) in first.items() for seq, own, before, _ in held if own + 1 in first and seq < s and p - before < budget and (own == k - 1 or p1 - first[own + 1][2] < budget)}
        assert {(r["chunk_id"], r["seq"]) for r in segment.head(rows, budget).collect()} == want


def test_rewrite_error_is_a_column(spark):
    pages = spark.createDataFrame([(1, "<p>a<b>b</b></p>"), (2, "<p>c</p>")], "page_id long, html string")
    texts = spark.createDataFrame([(1, 1, "x"), (2, 1, "C")], "page_id long, frag_index long, text string")
    got = {r["page_id"]: (r["n_groups"], r["html"], r["error"]) for r in html.rewrite_pages(pages, texts).collect()}
    assert got == {1: (0, "<p>a<b>b</b></p>", "expected 2 fragments, got 1"), 2: (1, "<p>C</p>", None)}
    content, link = html.document('<head><link href=x rel="a"><link href=y></head><body class="k"><p>é</p></body>')
    assert content.decode() == '<body class="k"><p>é</p></body>' and link == {"rel": "a", "href": "x", "type": None}
    assert html.document("plain") == (b"plain", None)


def test_stream_twice_in_one_session(spark):
    """With a checkpoint folder set, as conftest does: a second call starts anew."""
    assert spark.conf.get("spark.checkpoint.dir")
    once = QUERIES["stream_checks"](spark, DATA).count()
    assert once > 0 and QUERIES["stream_checks"](spark, DATA).count() == once


def test_two_phase(spark, tmp_path):
    rows = [(1, 0, "one met Temporal Matrix"), (1, 1, "two met Temporal Matrix"), (2, 0, "three"), (3, 0, "four")]
    df = spark.createDataFrame(rows, "doc_id long, pos long, text string")
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    first, asked = counting(tmp_path / "a", translate.mock)
    second, again = counting(tmp_path / "b", lambda p, r: f"<0/>fine\n<1/>good\n{END}" if "Lines: 2" in p else "broken")
    known = spark.createDataFrame([("2/0", "trois")], "key string, text string")
    run = translate.two_phase(df, first, second, initial=known, validated=spark.createDataFrame([("Matrix", "Grille")], "source string, target string"))
    got = {r["key"]: (r["text"], r["origin"]) for r in run.stored.collect()}
    assert got == {"1/0": ("fine", "refined"), "1/1": ("good", "refined"), "2/0": ("trois", "initial"), "3/0": ("FOUR", "initial")}
    assert len(asked()) == 2 and not any("three" in c for c in asked()) and "into fr" in asked()[0]  # what the store has is not asked for
    assert len(again()) == 3 and any("Matrix → Grille" in c and "<0/>ONE MET TEMPORAL MATRIX" in c for c in again())
    assert {r["source"]: r["target"] for r in run.glossary.collect()}["Matrix"] == "Grille" and run.first_log.count() == 2 and run.second_log.count() == 3
    summary = {r["metric"]: r["value"] for r in translate.run_summary(run.stored, run.second_log, 1.5).collect()}
    assert summary == {"lines_refined": 2, "lines_initial": 2, "chunks": 3, "calls": 3, "seconds": 1.5}


def test_books_in_one_piece_are_as_those_spread_over_tasks(spark):
    """Both ways of a run, with forgotten lines, quotes, gaps in context, stored lines, and keys that no line has."""
    from docflow.plans.queries import refiner

    def forgetful(prompt, reasoning=False):
        rows = re.findall(r"^<([0-9]+)/>(.*)$", prompt, re.M)
        return "\n".join([*(f"<{i}/>{t.upper().replace('“', '')}" for i, t in rows if len(t) % 23), END])

    r = __import__("random").Random(3)
    word = lambda: r.choice(["Temporal", "Matrix", "the", "came", *["of"] * 9, "“so”", "a</>b", "Été", "NASA", "x\x1cY", "\u3000end "])
    rows = [(book, 3 * i, " ".join(word() for _ in range(r.randint(1, 60)))) for book in range(1, 13) for i in range(r.randint(1, 30))] + [(40, 0, "long " * 3000), (40, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, text string")
    kind = "key string, text string"
    initial = spark.createDataFrame([(f"{b}/{i}", f"old {b} {i}") for b in (2, 5, 6) for i in range(0, 12, b - 1)] + [("x/y", "odd"), ("999/3", "of no book"), ("2/9999", "beyond"), ("02/1", "other key"), ("7/1", None)], kind)
    refined = spark.createDataFrame([(f"{b}/{i}", "" if i % 3 == 0 else f"new {b} {i}") for b in (3, 5) for i in range(9)] + [("x/y", "odder"), ("998/1", "")], kind)
    s = translate.Settings(first_tokens=90, first_ratio=0.4, second_tokens=40, second_ratio=1.5, wait=0)
    found = []
    for most in (3000, 0):
        run = translate.two_phase(df, forgetful, refiner, s, initial, refined, most=most)
        found.append({k: sorted(map(norm, getattr(run, k).collect())) for k in ("initial", "refined", "stored", "quarantined", "glossary", "first_log", "second_log")})
    assert found[0]["stored"] and found[0]["quarantined"] and found[0]["glossary"] and len(found[0]["second_log"]) > 5
    for k, want in found[1].items():
        assert found[0][k] == want, k


def test_terms_of_words_are_those_of_columns(spark):
    odd = ["", " ", "One", "One two", "One Two", "a Dr Who-Is O'Neil NASA's eBay McDonald x\x1cY \u3000Été ÀB É", "İs Ǆ ǅx Ⅷa ⅷB", "A1 B_2 ABc aBC \x85Next", "the The tHe\x1fThe", None]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert [X.term_words(t or "") for t in odd] == [r["x"] or [] for r in df.select(X.terms(F.col("t")).alias("x")).collect()]


def test_summary_of_a_run_makes_no_prompts(spark):
    """A log's prompts are made for a reader that wants them only."""
    df = spark.createDataFrame([(1, 0, "one"), (1, 1, "two")], "doc_id long, pos long, text string")
    run = translate.two_phase(df, translate.mock, translate.mock)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan(run.second_log) and "Join" not in plan(run.second_log.agg(F.count("*"), F.sum("attempts")))


def test_stream_routes_every_row_once(spark, tmp_path):
    from docflow.streaming import checks as streaming

    df = pairs(spark, [("a</>b", "x"), ("c", None), ("d", "D"), ("“e”", "e")])
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    streaming.route(streaming.read_pairs(spark, f"{tmp_path}/in", 1), f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/good").count() == 1 and spark.read.parquet(f"{tmp_path}/bad").count() == 3


def test_operators_on_empty_tables(spark):
    none = pairs(spark, [("a", "b")]).limit(0)
    for f in (checks.fragment_count_errors, checks.punctuation_errors, checks.line_count_errors, checks.quarantine, checks.validation_stats):
        assert f(none).count() == 0
    assert segment.body(spark.createDataFrame([], "doc_id long, pos long, text string"), 10).count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["doc_id", "position", "sentence", "confidence"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists("/root/testdata/sf0.001")


def test_prompts(spark):
    from docflow.functions import prompts

    made = value(spark, prompts.second_pass(F.col("a"), F.col("b"), F.lit(None), F.lit(3)), a="orig", b="first")
    assert "orig" in made and "first" in made and "no terms" in made and "Lines: 3" in made
    assert "2 separators" in value(spark, prompts.retry_fragments(F.col("a"), F.lit(3)), a="x")
    asked = value(spark, prompts.missing_lines(F.col("a"), F.array(*[F.lit(i) for i in range(8)])), a="chunk")
    assert "0, 1, 2, 3, 4." in asked


def test_refinement_flags_missing_lines(spark):
    members = spark.createDataFrame([(1, 0, 1, 0, "a"), (1, 0, 1, 1, "b"), (1, 1, 1, 2, "c")], "book long, chunk_id int, role int, seq long, text string")
    initial = spark.createDataFrame([("1/0", "A"), ("1/2", "C")], "key string, text string")
    terms = spark.createDataFrame([("x → y",)], "prompt string")
    got = {r["chunk_id"]: r for r in store.refine_prompts(members, initial, terms).collect()}
    assert got[0]["has_missing"] and not got[1]["has_missing"] and "x → y" in got[1]["prompt"] and "<0/>A\n\n<1/>b" in got[0]["prompt"]


def test_summary_text(spark):
    obs = spark.createDataFrame([("Matrix", "Matrice", 0), ("Matrix", "Matrice", 1), ("Ahh", "Aah", 2), ("Ahh", "Oh", 3)], "source string, target string, seq long")
    counted = glossary.counts(obs)
    text = glossary.summary(counted, spark.createDataFrame([], "source string, target string"))
    assert "conflict Ahh: Aah, Oh" in text and "term Matrix: Matrice" in text and "total_terms: 2" in text

"""Line dedup, near duplicates, decontamination, secrets and toxicity against brute force."""

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest

from docflow.llm import decontam, line_dedup, minhash, secret_scan, toxicity
from docflow.llm.kernels import text_buffers

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACES = " \t\n\x0b\x0c\r"


def frame(spark, rows, extra="note string"):
    return spark.createDataFrame([(*r, None) for r in rows], f"doc_id long, text string, source string, {extra}")


def corpus(seed=3, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeÉß", k=r.randint(1, 6)))
    common = [" ".join(word() for _ in range(r.randint(3, 9))) for _ in range(12)]
    rows = []
    for i in range(n):
        lines = [r.choice(common) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 9))]
        if r.random() < 0.3:
            lines[0] = "  " + lines[0].upper() + "\t"
        rows.append((i, "\n".join(lines), f"src{r.randint(0, 4)}"))
    for k in range(60):  # near and exact copies
        i, text, s = rows[r.randint(0, n - 1)]
        words = text.split(" ")
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = word()
        rows.append((n + k, " ".join(words), s))
    return rows + [(900, None, None), (901, "", "src1"), (902, "short one", None), (903, "short ONE", "src2"), (904, " \t ", "src2"), (5, rows[5][1], "src0")]


def brute_lines(rows, least=20, docs=3):
    held = {}
    key = lambda line: line.strip(SPACES).translate(LOWER)
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(d)
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(held[key(x)]) < docs or d == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_line_dedup(spark, partitions):
    rows = corpus()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = line_dedup.dedup_lines(frame(spark, rows)).drop("text").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(map(tuple, got)) == brute_lines(rows)


def test_line_dedup_one_line_everywhere(spark):
    rows = [(i, "a line that all of them hold\nown " + "x" * i, "s") for i in range(500)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[499].startswith("a line") and sum(t.startswith("a line") for t in got.values()) == 1


def test_line_dedup_keeps_columns_and_empty_tables(spark):
    df = frame(spark, corpus())
    out = line_dedup.replace_text(df, line_dedup.keep_bitmaps(df))
    assert out.columns == df.columns and out.count() == df.count()
    assert out.where("doc_id = 900").first()["text"] is None
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def brute_components(rows, percent):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("percent", [85, 60])
def test_near_duplicates(spark, percent):
    rows = corpus(5)
    got = minhash.near_duplicates(frame(spark, rows), percent=percent, recall=0.999999).drop("text_hash").collect()
    assert sorted(map(tuple, got)) == brute_components(rows, percent)


def test_near_duplicates_large_group(spark):
    r = random.Random(2)
    base = ["w%d" % i for i in range(120)]
    rows = []
    for i in range(700):  # more classes than a block holds
        words = list(base)
        words[r.randrange(120)] = "x%d" % i
        rows.append((i, " ".join(words), "s"))
    got = minhash.near_duplicates(frame(spark, rows)).drop("text_hash").collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 85)


def test_near_duplicates_among_documents_that_quote_them(spark):
    def signed(texts):
        data, offsets = text_buffers(pa.array(texts))
        values, offs = minhash.shingle_sets(data, offsets, 5)
        return values, minhash.signatures(values, offs, 32)

    words = [f"w{i}" for i in range(60)]
    pair = [" ".join([*words, "t45"]), " ".join([*words[6:], "t101"])]  # of similarity 50 / 58, with large class ids
    windows = [" ".join(words[i : i + 5]) for i in range(56)]
    values, _ = signed(windows)
    window = dict(zip(values.tolist(), windows))
    _, (one, two) = signed(pair)
    hashes, mins = minhash._seeds(32), {}
    for k, seed in enumerate(hashes):
        h = values * seed
        mins[k] = window[int(values[(h ^ (h >> np.uint64(29))).argmin()])]
    same = [all(one[k] == two[k] for k in (2 * b, 2 * b + 1)) for b in range(16)]
    rows = [(0, pair[0], "s"), (1, pair[1], "s")]
    for i in range(8):
        for j in range(8, 16):
            if same[i] and same[j]:  # quotes of the four passages that decide this key of both, and unlike text between
                for v in range(40):
                    quotes = [mins[k] for k in (2 * i, 2 * i + 1, 2 * j, 2 * j + 1)]
                    rows.append((len(rows), " ".join(f"{q} f{i}x{j}v{v}" for q in quotes), "s"))
    got = minhash.near_duplicates(frame(spark, rows)).drop("text_hash").collect()
    assert {r["doc_id"]: r["component_id"] for r in got}[1] == 0


def test_pairs_that_could_link_are_all_pairs():
    r = np.random.default_rng(3)
    sketches = np.repeat(r.integers(1, 256, (20, minhash.BINS), dtype=np.uint8), 5, axis=0)
    sketches[:, 100:] *= r.random((100, minhash.BINS - 100)) < 0.3
    for x in sketches:
        x[r.permutation(minhash.BINS)[: r.integers(0, 60)]] = r.integers(1, 256)
    limits = minhash.sketch_limits(0.85, 2e-5)
    x = {"cid": np.arange(100), "outside": r.random(100) < 0.5, "label": r.integers(0, 40, 100), "n": r.integers(80, 100, 100), "sketch": sketches}
    asks = np.flatnonzero(x["outside"])
    i, j = minhash.could_link({k: v[asks] for k, v in x.items()}, x, limits, 85)

    def near(i, j):
        differ, seen = (sketches[i] != sketches[j]).sum(), ((sketches[i] > 0) | (sketches[j] > 0)).sum()
        sizes = sorted((int(x["n"][i]), int(x["n"][j])))
        return differ <= limits[seen] and x["label"][i] != x["label"][j] and 100 * sizes[0] >= 85 * sizes[1] and (x["outside"][i] or x["outside"][j])

    got = [tuple(sorted(p)) for p in zip(asks[i].tolist(), j.tolist())]
    assert sorted(got) == [(i, j) for i in range(100) for j in range(i + 1, 100) if near(i, j)] and got


def test_links_are_within_the_sketch_limits():
    r = np.random.default_rng(5)
    limits = minhash.sketch_limits(0.85, 2e-5)
    for n in [*range(1, 40), *range(40, 900, 9)] * 8:
        both = r.integers(0, 2**64, n, dtype=np.uint64)
        more = r.integers(0, 2**64, int(n * 0.15 / 0.85), dtype=np.uint64)  # of similarity 0.85 at least
        cut = r.integers(0, len(more) + 1)
        pair = [np.unique(np.concatenate([both, m])) for m in (more[:cut], more[cut:])]
        a, b = minhash.sketches(np.concatenate(pair), np.cumsum([0, *map(len, pair)]))
        assert (a != b).sum() <= limits[((a > 0) | (b > 0)).sum()]


def test_near_copies_cost_what_their_members_cost(spark, monkeypatch):
    """Blocks of a crowd hold all of it; what is left to be asked for one by one is a small part."""
    r = random.Random(6)
    base = ["w%d" % i for i in range(120)]
    rows = []
    for i in range(3000):
        words = list(base)
        words[r.randrange(120)] = "x%d" % i
        rows.append((i, " ".join(words), "s"))
    asked = []
    whole = minhash.mixed_cells
    monkeypatch.setattr(minhash, "mixed_cells", lambda *a: (asked.append(whole(*a).where("asks").count()), whole(*a))[1])
    got = minhash.near_duplicates(frame(spark, rows)).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0] and asked[0] < 300


def test_equal_first_hashes_do_not_multiply_rows(spark, monkeypatch):
    signed = minhash.signed
    monkeypatch.setattr(minhash, "signed", lambda *a: signed(*a).selectExpr("doc_id", "text_hash", "n", "7L AS c1", "c2", "left", "right", "sketch"))
    rows = corpus(5)
    assert sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).drop("text_hash").collect())) == brute_components(rows, 85)


def test_near_duplicates_of_very_long_texts(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words), "s"), (2, " ".join([*words[:59_000], "other"]), "s"), (3, " ".join(words[:30_000]), "s"), (4, "x" * 3_000_000, "s"), (5, "x" * 3_000_000, "s")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_keep_one_and_empty(spark):
    df = frame(spark, corpus(5), "doc string")
    kept = minhash.keep_one(df, percent=80)
    assert kept.columns == df.columns
    want = [x[0] for x in brute_components(corpus(5), 80) if x[3]]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for t in (0.8, 0.85, 0.95):
        m = minhash.bands_for(t, 2, 0.9998)
        assert (1 - (1 - t**2) ** m) ** 2 >= 0.9998 > (1 - (1 - t**2) ** (m - 1)) ** 2


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "beta, gamma; DELTA epsilon zeta eta theta iota kappa lambda mu nu"), (3, "tiny item"), (4, None), (5, "..."), (6, "é É x"), (30, "tiny item")]
TEXTS = [
    (1, "say alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu and a tiny ITEM too", "s"), (2, None, "s"), (3, "", "s"), (4, "tiny, item tiny item", None),
    (5, "é É x É é x", "s"), (6, "alpha beta gamma delta epsilon zeta eta theta iota", "s"), (4, "tiny, item tiny item", None), (7, "word " * 5000 + "tiny item", "s"),
]


def brute_hits(texts, items, n=10):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pat.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t, _ in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= own
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("most", [decontam.BROADCAST, 1])
def test_decontamination(spark, most):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = frame(spark, TEXTS, "row string")
    got = decontam.decontaminate(df, bench, broadcast_bytes=most).collect()
    assert sorted(map(tuple, got)) == brute_hits(TEXTS, ITEMS)
    clean = decontam.clean_documents(df, bench, broadcast_bytes=most)
    assert clean.columns == df.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(x[0] for x in brute_hits(TEXTS, ITEMS) if not x[5])


def test_decontamination_empty(spark):
    bench, df = spark.createDataFrame(ITEMS, "item_id long, text string"), frame(spark, TEXTS)
    assert decontam.decontaminate(df.limit(0), bench).count() == 0
    assert decontam.decontaminate(df, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_runs_no_python(spark, monkeypatch):
    """Every plan that the operator runs, not only what is left of it after its tables are written."""
    bench, df = spark.createDataFrame(ITEMS, "item_id long, text string"), frame(spark, TEXTS)
    plans = []
    for name in ("written", "checkpointed"):
        run = getattr(decontam, name)
        monkeypatch.setattr(decontam, name, lambda d, *a, run=run: (plans.append(d), run(d, *a))[1])
    plans += [decontam.decontaminate(df, bench), decontam.clean_documents(df, bench)]
    read = [d._jdf.queryExecution().executedPlan().toString() for d in plans]
    assert len(read) == 7 and any("regexp_extract_all" in p for p in read)
    assert not any(re.search("Python|Pandas|Arrow", p.replace("PythonRDD", "")) for p in read)


def test_decontamination_by_many_windows(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(r.choices(words, k=60))) for i in range(2000)]  # 102 000 windows
    texts = [(i, " ".join(r.choices(words, k=300)), "s") for i in range(40)] + [(100 + i, "x y " + items[i][1] + " z", "s") for i in range(0, 2000, 97)]
    got = decontam.decontaminate(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_hits(texts, items)


def test_helper_columns_do_not_clash(spark):
    bench = spark.createDataFrame([(3, "tiny item")], "item_id long, text string")
    rows = [(i, "a tiny item" if i % 3 else f"one line that all of them hold\nown {i} text", i, "k", None) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, keep string, `__doc` string").selectExpr("*", "row AS maybe", "row AS w", "row AS doc", "row AS text_hash", "keep AS `__keep`", "keep AS `a.b`")
    for out in (decontam.clean_documents(df, bench), line_dedup.replace_text(df, line_dedup.keep_bitmaps(df)), minhash.keep_one(df)):
        got = out.collect()
        assert out.columns == df.columns and got and all(r["row"] == r["doc_id"] == r["w"] and r["keep"] == "k" == r["a.b"] for r in got)
    assert line_dedup.replace_text(df, line_dedup.keep_bitmaps(df)).where("text LIKE 'one line%'").select("doc_id").collect() == [(6,)]


def test_very_long_texts(spark):
    r = random.Random(3)
    long = "\n".join(" ".join(r.choices("abcdefgh", k=40)) for _ in range(20_000)) + "\nthe very same line of all\n" + "y" * 500_000
    rows = [(i, f"{long}\nend {i}", "s") for i in range(3)] + [(9, "the very same line of all", "s")]
    got = sorted(map(tuple, line_dedup.dedup_lines(frame(spark, rows)).drop("text").collect()))
    assert got == brute_lines(rows)
    rows = [(1, long + " secret=" + "q1" * 40, "s")]
    assert secret_scan.scan_secrets(frame(spark, rows)).first()["n_assign"] == 1
    bench = [(1, "the very same line of all")]
    rows = [(1, long, "s")]
    assert sorted(map(tuple, decontam.decontaminate(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect())) == brute_hits(rows, bench)


def test_spans_that_agree_modulo_powers_of_two():
    from docflow.llm.kernels import span_hashes

    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096)).encode()
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(a + b + a, np.uint8)
    for which in (0, 1):
        h = span_hashes(data, np.array([0, 4096, 8192]), np.array([4096, 8192, 12288]), which)
        assert h[0] == h[2] != h[1]


def brute_secrets(text):
    text, out = text or "", []
    for kind, pat, least in (("assign", r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, m in enumerate(re.finditer(pat, text)) if len(m[2] if kind == "assign" else m[0]) >= least]
    order = ["assign", "access", "hex"]
    return [s for _, _, s in sorted((a, order.index(s.split(":")[0]), s) for a, _, s in out)]


def test_secrets(spark):
    live, shared = "ghq9Xk2LmZ8rT4vWb7Yd1Pf6", "Zk3Qv8Lw5Rt2Xy9Bn4Mj7Hc1"
    rows = [
        (1, f'é password = "abcdefgh1" PASSWD:short token=\'{"0a1b2c3d" * 5}\'', "a"), (2, "AKIAABCDEFGHIJKL AKIASHORT " + "f" * 32, "a"), (3, None, "b"), (4, "", None),
        (5, f"key {live} end", "a"), (6, f"{shared}", "a"), (7, f"x {shared}", "b"), (8, f"{shared} y {shared}", "c"), (1, "api_key: ABCDEFGH", "z"), (9, "passKword=ſecret=abcdefghij", "a"), (10, "a" * 30_000 + " secret=" + "x" * 9000, None),
    ]
    got = {}
    for r in secret_scan.scan_secrets(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for d, text, _ in rows:
        base = brute_secrets(text)
        digest = hashlib.sha256(",".join(base).encode()).hexdigest()
        assert any(r["base_sha256"] == digest and r["n_assign"] + r["n_access"] + r["n_hex"] == len(base) for r in got[d])
        assert any([s for s in r["spans"].split(",") if s and not s.startswith("owned")] == base for r in got[d])
    assert got[5][0]["spans"] == f"owned:4:{4 + len(live)}" and got[5][0]["n_live"] == 1
    assert got[6][0]["spans"] == "" and got[8][0]["spans"] == ""
    assert secret_scan.scan_secrets(frame(spark, rows).limit(0)).count() == 0


def test_long_unlabelled_tokens():
    r = random.Random(8)
    long, late = "a1" + "".join(r.choices(string.ascii_letters + string.digits, k=400)), "".join(r.choices(string.ascii_letters, k=60)) + "7" * 3 + "xYz"
    for value in (long, late):
        assert secret_scan.scan_text(f"key {value} end") == [(3, 4, 4 + len(value), value)]
    assert secret_scan.scan_text("x" * 30_000 + " " + "".join(r.choices(string.ascii_letters, k=300))) == []


def test_ownership_counts(spark):
    rows = [(i, "token=abcdefgh12345678 token=abcdefgh12345678", f"s{i % 7}") for i in range(30)]
    found = secret_scan.candidates(frame(spark, rows), "source")
    assert [tuple(r)[1:] for r in secret_scan.ownership(found).collect()] == [(7, 30, 60)]


def test_ownership_decides_as_counted_by_hand(spark):
    """Every value of a random corpus against distinct owners and documents counted in Python."""
    r = random.Random(21)
    values = ["".join(r.choices(string.ascii_letters + string.digits, k=24)) + "9z" for _ in range(40)]
    rows = []
    for i in range(400):
        own = r.choices(values, weights=[1 / (k + 1) for k in range(40)], k=r.randint(0, 2))
        rows.append((i, " ".join(f"token={v}" if r.random() < 0.5 else v for v in own), r.choices(["a", "b", "c", "d", None], weights=[60, 5, 5, 5, 5])[0]))
    rows += [(1000 + i, f"token=onlyOneSource77x {values[39]}", "hot") for i in range(500)]
    owners, repositories = {}, {}
    for d, t, s in rows:
        for v in set(t.replace("token=", "").split()):
            owners.setdefault(v, set()).add(s or "")
            repositories.setdefault(v, set()).add((d, s or ""))
    copied = {v for v in owners if len(owners[v]) >= 3 or len(repositories[v]) >= 10}
    assert "onlyOneSource77x" in copied and len(owners["onlyOneSource77x"]) == 1 and 0 < len(copied) < len(owners)
    for r_ in secret_scan.scan_secrets(frame(spark, rows)).collect():
        text = next(t for d, t, _ in rows if d == r_["doc_id"])
        words = text.split()
        labelled = [w[6:] for w in words if w.startswith("token=")]
        bare = [w for w in words if not w.startswith("token=")]
        assert r_["n_copied"] == sum(v in copied for v in labelled)
        assert r_["n_live"] == sum(v not in copied for v in labelled + bare)
        assert r_["spans"].count("owned") == sum(v not in copied for v in bare)


def toxic_corpus():
    r = random.Random(9)
    rows, labels = [], []
    for i in range(1500):
        words = ["".join(r.choices("aeinrst", k=r.randint(1, 5))) for _ in range(r.randint(5, 80))]
        bad = i % 9 == 0
        if bad:
            for _ in range(r.randint(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(["blorgo", "zxkvu", "grimpfen", "grimpfhaft"]))
        rows.append((i, " ".join(words), "s"))
        if i % 4:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    docs = frame(spark, [*rows, (None, "zxkvu blorgo", "s"), (5000, None, "s"), (5001, "", "s")])
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, lab)).collect()}
    assert len(got) == len(rows) + 3
    assert all(got[i]["predicted"] == int(i % 9 == 0) for i, _, _ in rows)
    assert got[5001]["predicted"] == 0 and got[5000]["score"] == got[5001]["score"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items() if d is not None)
    kept = toxicity.reject(docs, toxicity.fit(docs, lab))
    assert kept.columns == docs.columns and kept.where("doc_id % 9 = 0 and doc_id < 1500").count() == 0


def test_toxicity_of_words_that_clean_texts_hold_too(spark):
    r = random.Random(12)
    bad, rows, labels = ["blorgo", "zxkvu", "grimpfen", "quabble", "vorrtix", "humdrex", "plinkow", "tazzumi"], [], []
    for i in range(3000):
        words = ["".join(r.choices("aeinrst", k=r.randint(1, 5))) for _ in range(40)]
        toxic = i % 5 == 0
        words += [w for w in bad if r.random() < (0.5 if toxic else 0.05)]
        r.shuffle(words)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, rows), toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    held = [i for i in range(3000) if got[i]["held_out"]]
    caught = [got[i]["predicted"] for i in held if i % 5 == 0]
    assert sum(caught) > 0.8 * len(caught)
    assert sum(got[i]["predicted"] for i in held if i % 5) < 0.03 * len(held)


def test_only_copies_of_equal_label_are_collapsed(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(f"{shared} own{i} words{i} here{i}", i % 2, i % 3 % 2) for i in range(60)]
    rows += [(f"{shared} own7 words7 here7", 0, 0), (f"{shared} own7 words7 here7", 1, 0), (None, 1, 0)]
    df = spark.createDataFrame(rows, "text string, toxic int, fold int")
    got = [tuple(r) for r in toxicity.one_of_copies(df).select("text", "toxic").collect()]
    assert len(got) == len(set(got)) and set(got) == {r[:2] for r in rows}


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "some text", "s")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).first()["predicted"] == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).count() == 0


def test_segments_of_falling_sums_take_linear_time():
    import time

    n = 200_000
    began = time.perf_counter()
    found = toxicity.maximal_segments(list(range(0, 40 * n, 40)), [1.0] * n, -0.05)
    assert len(found) == n and time.perf_counter() - began < 10


def test_extreme_law_finds_what_made_the_scores():
    r = np.random.default_rng(8)
    rate, scale = 0.7, 0.02
    words = r.integers(20, 2000, 20_000)
    best = (np.log(scale * words) + r.gumbel(size=len(words))) / rate
    hit = best > 0
    got = toxicity.extreme_law(best[hit], words[hit].astype(float), np.ones(hit.sum()), float(words[~hit].sum()), 1.0)
    assert abs(got[0] / rate - 1) < 0.05 and abs(got[1] / scale - 1) < 0.1
    assert toxicity.extreme_law(np.zeros(0), np.zeros(0), np.zeros(0), 1000.0, 0.9)[0] == 0.9


def test_scores_match_brute_force(spark):
    """Word scores, segments, law and logistic of a fitted model, word by word in Python."""
    import math

    rows, labels = toxic_corpus()
    rows = [*rows, (7000, "blorgo " + "nae " * 150_000 + "zxkvu grimpfen", "s")]
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    odds = dict(zip(model.feature.tolist(), model.odds.tolist()))

    def hashes(word):
        data = np.frombuffer(word.encode(), np.uint8)
        _, _, found = toxicity.features(data, np.array([0, len(data)]))
        return [int(h[0]) for _, h in found if len(h)]

    known = {}

    def score(text):
        x = []
        for w in text.split():
            if w not in known:
                known[w] = max([odds.get(h, 0.0) for h in hashes(w)], default=0.0)
            x.append(known[w])
        x = [v if v >= model.least and v > 0 else model.other for v in x]
        total, stack = 0.0, [(0, len(x))]
        sums = np.concatenate([[0.0], np.cumsum(x)])
        while stack:  # the best segment of a stretch, then what lies left and right of it
            a, b = stack.pop()
            if a >= b:
                continue
            low = np.minimum.accumulate(sums[a:b])
            gains = sums[a + 1 : b + 1] - low
            end = int(gains.argmax())
            if gains[end] <= 1e-9:
                continue
            start = int(sums[a : a + end + 1].argmin())
            total += max(0.0, model.rate * gains[end] - max(0.0, math.log(model.scale * len(x))))
            stack += [(a, a + start), (a + end + 1, b)]
        return 1 / (1 + math.exp(-(model.offset + model.slope * math.log1p(total))))

    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, rows), model).collect()}
    assert max(abs(got[d] - score(t)) for d, t, _ in rows) < 1e-6


def test_maximal_segments_match_brute_force():
    r = random.Random(4)

    def brute(x):
        """Ruzzo and Tompa's definition by recursion: the best segment, then those left and right of it."""
        best = max(((sum(x[i:j]), -i, -j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return []
        i, j = -best[1], -best[2]
        return brute_at(x, 0, i) + [(round(best[0], 6), i, j - 1)] + brute_at(x, j, len(x))

    def brute_at(x, a, b):
        return [(s, i + a, j + a) for s, i, j in brute(x[a:b])]

    for _ in range(60):
        x = [r.choice([-0.37, -0.37, -0.37, 1.13, 0.71]) for _ in range(r.randint(1, 16))]
        at = [i for i, v in enumerate(x) if v > 0]
        got = toxicity.maximal_segments(at, [x[i] for i in at], -0.37)
        assert sorted(round(s, 6) for s, _, _ in got) == sorted(s for s, _, _ in brute(x))

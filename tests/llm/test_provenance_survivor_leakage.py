import base64
import random
from datetime import datetime

import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from scanloom.llm import leakage, provenance, survivor

HAND = "import os\n\ndef load(path):\n    # read the file once\n    with open(path) as f:\n        return f.read().strip()\n\ndef save(path, text):\n    if not text:\n        raise ValueError(path)\n    os.makedirs(path)\n"
LIBRARY = "".join(f"def helper_{k}(value, other):\n    result_{k} = transform_{k}(value) + {k} * other\n    return normalise_{k}(result_{k}, other)\n" for k in range(12))
MINIFIED = "!function(){" + "".join(f"var a{k}=function(e){{return e[{k}]>>2&{k}}};" for k in range(60)) + "}();"
GENERATED = "class A:\n" + "".join(f"    def get_f{k}(self):\n        return self._values[{k}]\n" for k in range(9))
BLOB = "ROWS = [\n" + "".join(f"    ({k}.5, {k + 1}.25, {k}, {k}, 7.125, 9.5),\n" for k in range(60)) + "]\n"


def files(spark, data):
    return spark.createDataFrame([(i, r, p, c, "x", 1.0) for i, r, p, c in data], "file_id long, repo string, path string, content string, dir string, e0 double")


def seen_of(df, *marked):
    """Evidence with given files marked."""
    seen = provenance.file_evidence(df, "file_id", "repo", "path", "content")
    return seen.withColumn("marked", seen["k"].isin(*marked))


def test_labels_of_files(spark):
    data = [
        (1, "a", "src/m/load.py", HAND), (2, "a", "src/m/pb.py", GENERATED), (3, "a", "web/app.js", MINIFIED), (4, "a", "src/data.py", BLOB), (5, "a", "src/head.py", "# Code generated by toolc. DO NOT EDIT.\n" + HAND),
        (6, "b", "deps/somekit/lib.py", "# somekit 1.2.3\n# (c) the somekit authors, released under the MIT license\n" + LIBRARY), (7, "c", "src/own/util.py", LIBRARY.replace("helper_3", "helper_three")), (8, "c", "src/own/licensed.py", "# SPDX-License-Identifier: Apache-2.0\n" + HAND),
        (9, "c", "tools/gen.py", HAND + '    out.write("# Code generated by gen. DO NOT EDIT.")\n'), (10, "d", "src/codes.py", HAND + "codes = [" + ", ".join(map(str, range(10000, 10300))) + "]\n" + HAND.replace("load", "fetch") * 12), (11, None, None, None), (12, "d", "x/empty.py", ""), (1, "a", "src/m/load.py", HAND),
    ]
    got = dict((r["file_id"], r["label"]) for r in provenance.label_files(files(spark, data), "file_id", "repo", "path", "content").collect())
    assert got == {1: "handwritten", 2: "generated", 3: "minified", 4: "blob", 5: "generated", 6: "vendored", 7: "vendored", 8: "handwritten", 9: "handwritten", 10: "handwritten", 11: "handwritten", 12: "handwritten"}
    assert provenance.label_files(files(spark, data).limit(0), "file_id", "repo", "path", "content").count() == 0


def test_marks_below_a_licence_in_a_long_comment_and_at_the_end():
    said = lambda text: provenance.evidence("src/a.py", text)
    licence = "".join(f"# term {k} of a long licence that says nothing of the kind\n" for k in range(200))
    block = "/* Code generated by toolc. DO NOT EDIT.\n" + licence.replace("#", " *") + " */\n"
    for text in (licence + "# @generated\n" + HAND, block + HAND, HAND + "\n# @generated\n\n", HAND + "/* made here\n * Code generated by toolc.\n */\n// end\n", HAND + "<!-- @generated -->\n"):
        assert said(text)[0][provenance.GENERATED] >= 8.0, text[-60:]
    assert said(HAND + "\n# somekit 1.2.3\n# (c) the somekit authors\n")[1]
    for text in (HAND + 'T = """\n# @generated\n"""\n', HAND + "# @generated\nx = 1\n", HAND + 'write_line("@generated")\n', HAND + 'x = 1 /* a */ + "@generated */"\n', HAND + "#endif @generated\n"):
        assert said(text)[0][provenance.GENERATED] < 8.0, text[-60:]


def test_a_redelivered_file_is_no_fuller_copy(spark):
    lines = [f"value_{k} = transform_the_value({k}, other)" for k in range(10)]
    mixed = "\n".join(lines[:5] + [x.replace("value", "own") for x in lines[5:]])
    df = files(spark, [(1, "a", "a.py", "\n".join(lines)), (2, "a", "b.py", mixed), (2, "a", "b.py", mixed), (3, "a", "c.py", "\n".join(lines[:9]))])
    assert rows(provenance.copies(seen_of(df, 1))) == [(1, 1.0), (3, 1.0)]


def test_structure_tells_whatever_the_names():
    fetch = "class A:\n" + "".join(f"    def fetch_{k}(self):\n        return self.slots[{k}]\n" for k in range(40))
    pairs = "".join(f'"key_{chr(97 + k % 26)}{k}": {k % 7},\n' for k in range(60))
    assert provenance.evidence("a.py", fetch)[0][provenance.GENERATED] == 7.0
    assert provenance.evidence("a.js", pairs)[0][provenance.BLOB] == 9.0 and provenance.evidence("a.js", "[1, 2, 3, 4, 5, 6, 7, 8, 9]")[0][provenance.BLOB] == 9.0
    assert provenance.periodic(HAND.split("\n")) < 0.3 and provenance.periodic(["x = 1"] * 40) == 0.0 and provenance.periodic([x for k in range(9) for x in (f'name_{k} = "a"', f"size_{k} = {k}")]) == 0.0 and provenance.periodic([]) == 0.0
    assert len(provenance.line_digests(None)) == 0 and len(provenance.line_digests(LIBRARY)) == 36 and len(provenance.line_digests("# note\nreturn find_the_first(value, other)\n")) == 1


def test_common_lines_meet_in_parts(spark, monkeypatch):
    data = [(k, "r", f"src/d{k % 7}/f{k}.py", LIBRARY if k % 3 else HAND) for k in range(60)] + [(100, "r", "deps/somekit/lib.py", "# somekit 1.2.3\n# (c) the somekit authors, released under the MIT license\n" + LIBRARY)]
    seen = provenance.file_evidence(files(spark, data), "file_id", "repo", "path", "content")
    few = rows(provenance.copies(seen))
    monkeypatch.setattr(provenance, "fixed_side", lambda side, most: side)
    assert rows(provenance.copies(seen)) == few == sorted(((k, 1.0) for k in [*range(60), 100] if k == 100 or k % 3), key=repr)


def test_short_copies_and_deep_directories(spark):
    body = "module.exports = require('./lib/padLeft')\n"
    df = files(spark, [(1, "a", "a.js", "// somekit 1.2.3\n" + body), (2, "b", "b.js", "\n" + body), (3, "b", "c.js", body.replace("Left", "Right")), (4, "b", "d.js", "x = 1\n"), (5, "a", "d.js", "// somekit 1.2.3\nx = 1\n"), (6, "a", "e.js", None)])
    assert rows(provenance.copies(seen_of(df, 1, 5))) == [(1, 1.0), (2, 1.0)]
    deep = "/".join(f"d{k}" for k in range(13)) + "/third_party/x.py"
    found = provenance.file_evidence(files(spark, [(1, "a", deep, HAND), (2, "a", "x.py", HAND)]), "file_id", "repo", "path", "content")
    assert rows(found.select("k", provenance.sibling_group(found["path"]))) == [(1, deep.replace("x.py", "*.py")), (2, "*.py")]


def test_neighbours_decide_where_files_say_nothing(spark):
    """The same file is taken for what its directory is; the messages are exact on a small tree."""
    plain = [(100 + k, "a", f"node_modules/kit-1.0.0/lib/f{k}.py", f"# kit{k} 1.0.{k}\n# (c) the kit authors, released under the MIT license\n{LIBRARY}") for k in range(6)]
    lone = HAND.replace("load", "lone")
    data = [*plain, (1, "a", "node_modules/kit-1.0.0/lib/other.py", lone), (2, "a", "src/other.py", lone)]
    got = dict((r["file_id"], r["label"]) for r in provenance.label_files(files(spark, data), "file_id", "repo", "path", "content").collect())
    assert got[1] == "vendored" and got[2] == "handwritten"


def test_propagation_equals_enumeration(spark):
    """Beliefs of a two-file directory against summing over all labels by hand."""
    ev = {1: [0.2, 1.4, -0.3, 0.1, 0.0], 2: [0.5, 0.9, 0.4, -0.2, 0.3]}
    df = spark.createDataFrame([(k, "r", "d", v) for k, v in ev.items()], "k long, repo string, dir string, ev array<double>")
    got = {r["k"]: (r["label"], r["confidence"]) for r in provenance.beliefs(df).collect()}
    T = lambda keeps: np.array([[keeps[i] if i == j else (1 - keeps[i]) / 4 for j in range(5)] for i in range(5)])
    prior = np.array(provenance.PRIOR)
    K, D = T(provenance.FILE_KEEPS), T(provenance.DIR_KEEPS)
    a, b = np.exp(ev[1]), np.exp(ev[2])
    joint = np.einsum("r,d,rd,da,db,a,b->ab", prior, prior, D, K, K, a, b)
    for k, p in ((1, joint.sum(1)), (2, joint.sum(0))):
        p /= p.sum()
        assert got[k] == (provenance.LABELS[int(p.argmax())], round(float(p.max()), 6))
    # the same files as siblings of one group below the directory, which has no usual shares of its own
    got = {r["k"]: (r["label"], r["confidence"]) for r in provenance.beliefs(df.replace("d", "d/*.py", ["dir"])).collect()}
    joint = np.einsum("r,d,rd,dg,ga,gb,a,b->ab", prior, prior, D, D, K, K, a, b)
    for k, p in ((1, joint.sum(1)), (2, joint.sum(0))):
        p /= p.sum()
        assert got[k] == (provenance.LABELS[int(p.argmax())], round(float(p.max()), 6))


FINDING = "finding_key long, scan_id long, repo string, file string, line int, col_number int, type string, confidence double, function_name string, recommendation string, code_snippet string, quote string, ingested_at timestamp, group string"
T0 = datetime(2025, 1, 1)


def finding(k, scan=1, repo="r", file="a/b.py", line=5, col=1, kind="xss", conf=0.5, fn="f", rec="x", code="c", quote="q"):
    return (k, scan, repo, file, line, col, kind, conf, fn, rec, code, quote, T0, "g")


def scan_table(spark):
    return spark.createDataFrame([(1, datetime(2025, 1, 1), "m1"), (2, datetime(2025, 1, 2), "m2"), (3, datetime(2025, 1, 3), None), (1, datetime(2025, 1, 1), "m1")], "scan_id long, scanned_at timestamp, model_used string")


def test_survivors(spark):
    data = [
        finding(1), finding(2, scan=2, file="./a/b.py", line=7, kind=" XSS ", conf=60.0, quote="n/a", fn="f"), finding(3, scan=3, file="C:\\s\\r\\a\\b.py", line=8, kind="Xss", conf=0.9), finding(1),  # one defect, 3 stays
        finding(4, line=20), finding(5, line=24),  # too far apart
        finding(6, repo="q", col=0, fn="", rec=None), finding(7, repo="q", conf=0.5), finding(8, repo=None), finding(9, file=None), finding(10, line=None), finding(11, repo=None),
    ]
    df = spark.createDataFrame(data, FINDING)
    assert rows(survivor.survivors(df, scan_table(spark))) == [(1, 3), (2, 3), (6, 7)]
    merged = {r["first_line"]: r for r in survivor.merged_records(df.where("repo = 'r'"), scan_table(spark)).collect()}
    assert merged[5]["n_records"] == 3 and merged[5]["confidence"] == 0.9 and merged[5]["best"]["quote"] == "q" and "q" in merged[5]["kept"]["quote"]
    assert survivor.survivors(df.limit(0), scan_table(spark)).count() == 0


def test_quality_tells_good_sources_from_bad(spark):
    """Three sources that agree and one that makes things up: its rates come out lower and its values lose."""
    rng, data = random.Random(3), []
    for g in range(60):
        for s in (1, 2, 3):
            data.append(finding(1000 * g + s, scan=s, file=f"f{g}.py", fn=f"true{g}"))
        data.append(finding(1000 * g + 4, scan=4, file=f"f{g}.py", fn=f"false{rng.random()}"))
    scans = spark.createDataFrame([(k, T0, f"m{k}") for k in (1, 2, 3, 4)], "scan_id long, scanned_at timestamp, model_used string")
    grouped, facts = survivor.judged_groups(spark.createDataFrame(data, FINDING), scans)
    quality = survivor.source_quality(survivor.fact_counts(survivor.stated(grouped)).where("field = 'function_name'"))
    assert quality["m1"][0] > quality["m4"][0] and quality["m1"][1] > quality["m4"][1]
    f = facts.where("field = 'function_name'")
    assert f.where("value LIKE 'true%' AND p < 0.5").count() == 0 and f.where("value LIKE 'false%' AND p > 0.5").count() == 0


def test_the_model_decides_and_crowded_places_go_the_other_way(spark, monkeypatch):
    """Records that exceed each other: the one whose values are judged true stays, though the other has more fields filled."""
    rng, data = random.Random(3), []
    for g in range(60):
        for s in (1, 2, 3):
            data.append(finding(1000 * g + s, scan=s, file=f"f{g}.py", fn=f"true{g}", rec="fix it", quote="n/a"))
        data.append(finding(1000 * g + 4, scan=4, file=f"f{g}.py", fn=f"false{rng.random()}", rec=f"r{rng.random()}", quote=f"q{rng.random()}", conf=0.2))
        data += [finding(1000 * g + 10 + k, scan=rng.randrange(1, 5), file=f"f{g}.py", line=rng.randrange(100, 200), fn=rng.choice(["a", "b", None]), quote=rng.choice(["n/a", "x", "y"]), conf=rng.choice([0.3, 0.6, 70.0])) for k in range(30)]
    scans = spark.createDataFrame([(k, T0, f"m{k}") for k in (1, 2, 3, 4)], "scan_id long, scanned_at timestamp, model_used string")
    df = spark.createDataFrame(data + data[::7], FINDING)
    got = rows(survivor.survivors(df, scans))
    for g in range(60):
        assert {b for a, b in got if a // 1000 == g and a % 1000 <= 4} == {1000 * g + 1}
    assert len({a for a, _ in got}) == len(got)
    loose = rows(survivor.survivors(df, scans, check=False))
    monkeypatch.setattr(survivor, "PLACE_ROWS", 20)
    monkeypatch.setattr(survivor, "LOCAL_PATTERNS", 0)
    assert rows(survivor.survivors(df, scans)) == got and rows(survivor.survivors(df, scans, check=False)) == loose


@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_index_finds_every_occurrence(seq, phrase):
    index = leakage.FMIndex(np.array(seq), 5)
    lo, hi = index.find(np.array([phrase]))
    at = sorted(index.locate(np.arange(lo[0], max(hi[0], lo[0]))).tolist())
    assert at == [i for i in range(len(seq) - len(phrase) + 1) if seq[i : i + len(phrase)] == phrase]


@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(0, 6), st.integers(0, 60))
@settings(max_examples=100, deadline=None)
def test_wavelet_ranks(seq, c, i):
    m = leakage.WaveletMatrix(np.array(seq), 3)
    i = min(i, len(seq))
    assert m.rank(np.array([c]), np.array([i]))[0] == seq[:i].count(c)
    assert m.access(np.arange(len(seq))).tolist() == seq


WORDS = [f"w{k}x" for k in range(400)]


def item(seed, n=60):
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


def test_leaks_table(spark):
    a, b = item(1), item(2)
    stock = "Pick the repair that closes the hole."
    items = spark.createDataFrame([(1, stock + " " + " ".join(a), "s"), (2, " ".join(b) + ". " + stock, "s"), (3, None, "s"), (4, "too short", "s"), (1, stock + " " + " ".join(a), "s")], "item_id long, text string, suite string")
    q = a[10:40]
    shuffled = q[:]
    random.Random(1).shuffle(shuffled)
    changed = [w for k, w in enumerate(q) if k != 12]
    changed[6], changed[20:20] = "other", ["really"]
    wrap = lambda ws: "\n".join(f"  {k + 1}: {' '.join(ws[5 * k : 5 * k + 5])}" for k in range(-(-len(ws) // 5)))
    docs = [
        (1, "x " + " ".join(q) + " y"), (2, " ".join(q).upper()), (3, wrap(q)), (4, "<br>".join(q)), (5, '{"t": "' + "\\n".join(q) + '"}'), (6, " ".join(changed)), (7, "\u200b ".join(q).replace("w", "ｗ")), (8, " ".join(a[:60] + b)), (9, "&nbsp;".join(q)), (10, "%20".join(q)),
        (20, " ".join(shuffled)), (21, " ".join(q[:12])), (22, " ".join(q[:12] + ["z"] * 30 + q[12:24])), (23, stock), (24, None), (25, ""), (26, "z " * 30000), (1, "x " + " ".join(q) + " y"),
    ]
    df = spark.createDataFrame([(k, t, "i") for k, t in docs], "doc_id long, text string, i string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, items, "doc_id", "text", "item_id", "text").collect()}
    assert got == {(k, 1) for k in (*range(1, 11),)} | {(8, 2)}
    assert leakage.leaks(df.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0 and leakage.leaks(df, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(item(k))) for k in range(1, 8)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(item(k)[5:45])) for k in range(1, 12)], "doc_id long, text string")
    monkeypatch.setattr(leakage, "ITEM_BYTES", 500)
    assert rows(leakage.leaks(docs, items, "doc_id", "text", "item_id", "text").select("doc_id", "item_id")) == [(k, k) for k in range(1, 8)]


def test_long_texts_go_through_several_shards(monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_SYMBOLS", 900)
    finder = leakage.LeakFinder([(1, " ".join(item(1)), frozenset()), (2, " ".join(item(2)), frozenset())])
    for at in (0, 500, 640, 700, 880, 3000):
        codes = finder.code("z " * at + " ".join(item(1)[5:50]) + " z" * (3200 - at))
        found = {r[1:] for part, base in finder.windows(codes) for r in finder.search([(0, part, base)])}
        assert {(1, 45, at, at + 44)} <= found and {x[0] for x in found} == {1}, at
        assert all(len(p) <= 900 for p, _ in finder.windows(codes))


def test_shared_phrases_repeated_items_and_spans(spark):
    shared = [f"s{k}" for k in range(30)]
    variants = [(k, " ".join([f"x{k}", *shared, f"y{k}"])) for k in range(5)] + [(50 + k, " ".join(item(3))) for k in range(2)]
    docs = [(1, "a b " + " ".join(shared) + " c"), (2, "see:\n> " + " ".join(item(3)[5:30]) + "\nend"), (3, "Y" * 9 + " " + base64.b64encode(" ".join(item(3)).encode()).decode()), (4, " ".join(item(3)[:25]) + " z" * 60 + " " + " ".join(item(3)[10:40]))]
    items, df = spark.createDataFrame(variants, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = leakage.leaks(df, items, "doc_id", "text", "item_id", "text", spans=True).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, k) for k in range(5)} | {(d, i) for d in (2, 3, 4) for i in (50, 51)}
    cut = {(r["doc_id"], r["item_id"]): [docs[r["doc_id"] - 1][1][s["begin"] : s["end"]] for s in r["spans"]] for r in got}
    assert cut[1, 0] == [" ".join(shared)] and cut[2, 50] == [" ".join(item(3)[5:30])] and len(cut[3, 50][0]) > 100 and cut[4, 51] == [" ".join(item(3)[:25]), " ".join(item(3)[10:40])]

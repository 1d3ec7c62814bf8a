"""Forward matching, references by likeness and by chain, evidence, workbooks and filters, against plain Python."""

from __future__ import annotations

import difflib
import random
import re

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import forward, relations, verify
from spanloom.options import MatchOptions
from spanloom.plans import pipelines


def plain_match(ref, keys):
    """Of keys in their order: equal, a part, leading number, likeness."""
    if ref in keys:
        return keys[ref], 1
    if len(ref) >= 5:
        for key, at in keys.items():
            if len(key) >= 5 and not re.fullmatch(r"\d+(\.\d+)*", key) and (ref in key or key in ref):
                return at, 2
    if number := re.match(r"\d+(?:\.\d+)*", ref):
        best = None
        for key, at in keys.items():
            if found := re.match(r"\d+(?:\.\d+)*", key):
                a, b = number[0], found[0]
                if a == b:
                    return at, 3
                if (a.startswith(b) or b.startswith(a)) and (best is None or len(b) > best[0]):
                    best = len(b), at
        if best:
            return best[1], 3
    ratio, at = max(((difflib.SequenceMatcher(None, ref, key).ratio(), -n, at) for n, (key, at) in enumerate(keys.items())), default=(0, 0, None))[::2]
    return (at, 4) if ratio >= 0.7 else (None, None)


def test_references_by_brute_force(spark):
    rng = random.Random(8)
    entries, maps = [], {}
    for doc in ("文件甲", "文件甲乙", "丙"):
        seen = {}
        for i in range(25):
            number, title = rng.choice(["", f"{rng.randrange(1, 4)}.{rng.randrange(1, 30)}"]), "".join(rng.choices("停堆保护系统功能", k=rng.randrange(2, 9)))
            item = "" if number else f"<SYS-{rng.randrange(40)}>"
            key = item or f"{number} {title}"
            entries.append((doc, i, key, "c", item, number, title if number else ""))
            for form in (item, number, f"{number}{title}" if number else "", title if number else "", key.replace(" ", "")):
                if form:
                    seen.setdefault(form, i)
        maps[doc] = seen
    refs = []
    for _ in range(150):
        base = rng.choice([e[2] for e in entries] + ["1.2", "3", "9.9", "停堆保护", "<SYS-7>", "zq"])
        at = rng.randrange(len(base) + 1)
        refs.append((rng.choice(["文件甲", "甲", "文件甲乙", "丁", "丙 "]), rng.choice([base, base[:at] + "X" + base[at:], base[:at], f"见{base}", base.replace("<", "< ")])))
    order = {"文件甲": 0, "文件甲乙": 1, "丙": 2}
    df = spark.createDataFrame(entries, "doc string, ord long, key string, content string, item_id string, section_number string, section_title string")
    docs = spark.createDataFrame(list(order.items()), "doc string, doc_ord long")
    got = {(r.name, r.ref): (r.doc, r.ord, r.tier) for r in forward.matched_entries(spark.createDataFrame(refs, "name string, ref string"), forward.entry_keys(df), docs).collect()}
    for name, ref in set(refs):
        norm = "".join(ref.split())
        if not norm:
            assert (name, ref) not in got
            continue
        own = [d for d in order if d in name.replace(" ", "") or name.replace(" ", "") in d]
        expected = next(((d, *plain_match(norm, maps[d])) for d in [*own, *order] if plain_match(norm, maps[d])[0] is not None), None)
        assert got.get((name, ref)) == expected, (name, ref)


def test_alike_is_complete(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcd", k=rng.randrange(1, 14)))
    left, right = sorted({word() for _ in range(120)}), sorted({word() for _ in range(120)})
    a, b = spark.createDataFrame([(x,) for x in left], "x string"), spark.createDataFrame([(y,) for y in right], "y string")
    got = {(r.x, r.y): r.ratio for r in relations.alike(a, "x", b, "y", [], ["x", "y"]).collect()}
    assert got == {(x, y): m for x in left for y in right if (m := difflib.SequenceMatcher(None, x, y).ratio()) >= 0.7}
    parts = {(r.x, r.y) for r in relations.parted(a, "x", b, "y", []).collect()}
    assert parts == {(x, y) for x in left for y in right if x in y or y in x}


def test_chain(spark):
    items = spark.createDataFrame([("s", 0, "<DCS-SyRS001>", "one"), ("s", 1, "<DCS-SyRS002>", "two"), ("s", 2, "<X-SyRS2>", "late two")], "doc string, ord long, item_id string, content string")
    sections = spark.createDataFrame([("s", 3, "3.1", "架构设计", "text", "3.1架构设计")], "doc string, ord long, section_number string, section_title string, content string, full_key string")
    keys = relations.content_keys(items, sections)
    refs = ["<DCS-SyRS001>", "3.1", "关于架构设计", "<ABEFGHIJKLM-SyRS0002>", "SyRS001", "nothing like it", "< DCS-SyRS002>"]
    got = {r.ref: r.content for r in relations.resolved_by_chain(spark.createDataFrame([("s", r) for r in refs], "doc string, ref string"), keys, items).collect()}
    assert got == {"<DCS-SyRS001>": "one", "3.1": "text", "关于架构设计": "text", "<ABEFGHIJKLM-SyRS0002>": "late two", "SyRS001": "one", "< DCS-SyRS002>": "two"}


def test_forward_of_chapters_and_loose_references(spark):
    up = spark.createDataFrame([("需求说明书", "3.1 停堆要求\n系统应在信号产生时执行停堆。\n3.2 维修要求\n通道宽度应满足规范的要求。\n")], "doc string, text string")
    rows = spark.createDataFrame([("需求", "3.1", "旧文", "d", "<D1>"), ("别处", "维修要求", "", "d", "<D2>"), ("需求", "99 无", "", "d", "<D3>")], "upstream_doc string, upstream_ref string, upstream_content string, downstream_doc string, downstream_id string")
    out = {r.upstream_ref: (r.upstream_content, r.shown) for r in pipelines.forward(rows, up).collect()}
    assert out == {"3.1 停堆要求": ("旧文", "<D1>"), "3.2 维修要求": ("通道宽度应满足规范的要求。", "<D2>")}
    kept = {r.upstream_ref for r in pipelines.forward(rows, up, keep_orphans=True).collect()}
    assert kept == {"3.1 停堆要求", "3.2 维修要求", "99 无"}
    again = {r.upstream_ref: r.overall for r in pipelines.forward_verified(rows.withColumn("downstream_content", F.lit("系统应在信号产生时执行停堆。")), up).collect()}
    assert again["3.1"] == "GREEN" and again["99 无"] == "BLACK"


def test_evidence(spark):
    row = spark.range(1).select(T.untraced_evidence(F.array(F.struct(F.lit("d").alias("doc"), F.lit("k" * 30).alias("key"), F.lit(0.333).alias("score")))).alias("a"), T.untraced_evidence(F.array().cast("array<struct<doc:string,key:string,score:double>>")).alias("b")).first()
    assert row.a == f"UNTRACED | 参考候选: d:{'k' * 24}(0.33)" and row.b == "UNTRACED"


def test_shown_rows(spark):
    rows = spark.createDataFrame([("table", "<A-1>", "GREEN"), ("hybrid", "<a-2>", "BLUE")], "relation_source string, downstream_id string, overall string")
    assert pipelines.shown_rows(rows, search=" a-2 ").count() == 1 == pipelines.shown_rows(rows, source="table").count() == pipelines.shown_rows(rows, category="BLUE").count()
    assert pipelines.shown_rows(rows).count() == 2


def test_chain_and_case_agree(spark):
    """The decision chain in Python and the one expression give the same class for the same scores."""
    rng, o = random.Random(4), MatchOptions()
    pool = "停堆保护系统应提供定期试验"
    rows = []
    for i in range(400):
        a = "".join(rng.choices(pool, k=rng.randrange(1, 14)))
        b = rng.choice([a, a[:-1], a + rng.choice(pool), "".join(rng.choices(pool, k=9)), f" {a}"])
        sim, nli = rng.choice([0.3, 0.6, 0.72, 0.78, 0.82, 0.87, 0.96]), rng.choice([(0, 0, 0), (0.9, 0, 0), (0, 0.9, 0), (0, 0, 0.9)])
        x, y = verify.normal(a), verify.normal(b)
        ratio = lambda p, q: min(len(p), len(q)) / max(len(p), len(q), 1)
        scores = (verify.bigram_likeness(a, b), verify.charset_likeness(a, b), verify.lcs_ratio(a, b), ratio(x, y), len(a.strip()) <= 10 and len(b.strip()) <= 10 and a.strip() == b.strip(), x == y and len(x) >= o.min_phrase, ratio(a, b))
        rows.append((i, verify.classify(a, b, sim, lambda p, q: nli, o), sim, *map(float, scores[:4]), bool(scores[4]), bool(scores[5]), float(scores[6]), *map(float, nli)))
    df = spark.createDataFrame(rows, "i long, expected string, sim double, bigram double, charset double, lcs double, length_ratio double, short boolean, equal boolean, raw double, e double, n double, c double")
    got = verify.classified(*(F.col(c) for c in ("sim", "bigram", "charset", "lcs", "length_ratio", "short", "equal", "raw", "e", "n", "c")), o)
    assert df.withColumn("got", got).filter("got <> expected").collect() == []


def test_references_meet_only_keys_that_share_a_beginning(spark):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("ab1.") for _ in range(rng.randrange(n)))
    keys = list({(d, kind, key): (d, kind, key, f"c{i % 7}" if i % 7 else "", i) for i in range(120) for d, kind, key in [(rng.choice("xy"), rng.choice(("section", "full", "heading")), rng.choice(("1", "1.2", "12", "ab", some(9), some(40))))]}.values())
    refs = {(rng.choice("xy"), rng.choice(("1.2.1 a", "12 b", "1", some(6), some(50)))) for _ in range(80)}
    table = spark.createDataFrame(keys, "doc string, key_kind string, key string, content string, ord long").withColumn("key_norm", T.normal_reference(F.col("key")))
    found = relations.resolved(spark.createDataFrame(sorted(refs), "doc string, ref string"), table)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all(line.count(" = ") >= 2 for line in joins), joins
    norms = {r.x: r.n for r in spark.createDataFrame([(x,) for x in {k[2] for k in keys} | {r for _, r in refs}], "x string").select("x", T.normal_reference(F.col("x")).alias("n")).collect()}
    want = {}
    for doc, ref in refs:
        if not ref.strip():
            continue
        number, tries = re.match(r"([0-9]+([.][0-9]+)*)?", ref)[0], []
        exact = [(3 if kind == "section" else 4, 0, at, key) for d, kind, key, _, at in keys if d == doc and (kind == "section" and key == ref or kind == "full" and key in (ref, norms[ref]))]
        for d, kind, key, content, at in () if exact else keys:
            part = norms[key] in norms[ref] or norms[ref] in norms[key]
            if d != doc:
                continue
            if kind != "section" and part:
                tries.append((5 if kind == "full" else 6, 0, at, key))
            if kind == "section" and number and content and (key.startswith(number) or number.startswith(key)):
                tries.append((7, -(10**6) if key == number else -len(key), at, key))
        if exact or tries:
            want[doc, ref] = min(exact or tries)[0::3]
    assert {(r.doc, r.ref): (r.tier, r.key) for r in found.collect()} == want


def test_texts_that_could_be_alike_are_told_by_common_subsequences(spark):
    """Random hexadecimal texts nearly all share pairs of characters; they may not be compared for that."""
    rng = random.Random(5)
    some = lambda: "<" + "".join(rng.choice("0123456789abcdef") for _ in range(32)) + "9>"
    texts = [some() for _ in range(200)] + ["ab" * 40, "pump", "pumps"]
    held = relations.Texts([(t, {"all": 0}) for t in texts])
    near = texts[7][:20] + "x" + texts[7][24:]
    assert list(held.candidates(near, (0,), 0.7)) == [texts[7]]
    assert sum(len(list(held.candidates(t, (0,), 0.7))) for t in texts[:50]) == 50
    for text in ("pumpe", "ab" * 33, texts[3]):
        found = set(held.candidates(text, (0,), 0.7))
        assert {t for t in texts if difflib.SequenceMatcher(None, text, t).ratio() >= 0.7} <= found
    assert list(held.candidates("pump", (1,), 0.7)) == []

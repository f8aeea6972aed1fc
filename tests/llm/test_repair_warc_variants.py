"""Conversation repair, web archives and spelling variants against brute force."""

import base64
import gzip
import hashlib
import random
import re
import uuid
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrafold.llm import queries, repair, variants, warc
from terrafold.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


# --- repair ---------------------------------------------------------------------------------------


def all_paths(rows, c=repair.Costs()):
    """(cost, edits) of the cheapest right end, over whole strings of edits: nothing is pruned but what costs far more."""
    paths = {(0, "", repair.START)}

    def with_inserts(paths):
        out = set(paths)
        for cost, s, st in paths:
            for _ in range(3):
                st = repair.NEXT[st][repair.turn_of(st)]
                cost, s = cost + c.insert, s + "I"
                out.add((cost, s, st))
        return out

    for letter, fault in rows:
        new = set()
        for cost, s, st in with_inserts(paths):
            new.add((cost + c.delete, s + "D", st))
            if fault in ("blank", "duplicate"):
                continue
            p = c.truncated if fault == "truncated" else 0
            for x, to in repair.NEXT[st].items():
                if x == letter:
                    new.add((cost + p + c.keep, s + "K", to))
                if x in "ua":
                    new.add((cost + p + c.rerole, s + "R", to))
        low = min(x[0] for x in new)
        paths = {x for x in new if x[0] <= low + 14}
    return min((cost, s) for cost, s, st in with_inserts(paths) if st in repair.ENDS)


def test_search_equals_all_paths():
    rnd = random.Random(1)
    for _ in range(800):
        rows = [(rnd.choice("suauax").replace("x", ""), rnd.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rnd.randint(0, 6))]
        search, out = repair.Search(), []
        for letter, fault in rows:
            out += search.row(letter, fault)
        out += search.end()
        assert (search.cost, "".join(e for _, e in out)) == all_paths(rows)
        assert [n for n, _ in out] == list(range(len(rows) + 1)) and len(search.nodes) == 1


def test_search_frees_what_is_decided():
    rnd, search, most, out = random.Random(2), repair.Search(), 0, 0
    for i in range(20_000):
        out += len(search.row(rnd.choice("uaua") if i % 5 else "u", ""))
        most = max(most, len(search.nodes))
    assert most < 1000 and out > 19_000


def by_hand(rows):
    """Contract columns of one conversation's (turn, role, text) rows, by whole strings."""
    blank = set(" \t\n\x0b\x0c\r")
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        left = [x for x in text if x not in blank]
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = all_paths([(r[1][:1] if r[1][:1] in ("s", "u", "a") else "", f) for r, f in zip(rows, faults)])
    out, at, i = [], repair.START, 0
    for e in audit:
        _, role, text = rows[i] if e != "I" else (0, "", "")
        i += e != "I"
        if e == "D":
            continue
        letter = role[:1] if e == "K" else repair.turn_of(at)
        at = repair.NEXT[at][letter]
        out.append(f"{role if e == 'K' else repair.ROLES[letter]}:{text}")
    turns = {r[0] for r in rows if r[0] is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    n = Counter(faults)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged_by_hand(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out.setdefault(conv, [])
        if kind:
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def conversations():
    rnd = random.Random(3)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rnd.randint(1, 6)):
            turn = None if rnd.random() < 0.1 else turn + rnd.randint(0, 1)
            role = rnd.choice(["user", "assistant", "system", "tool", None, "user", "assistant", "assistantx", ""])
            rows.append((conv, turn, role, rnd.choice(["Yes.", "No!", "Well", None, "", " \n", "Why?\t", "é?", "Yes."])))
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, *rows[:9], (lost, 0, "user", "Gone.")]


def test_repair_against_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, lost_ int, edit string")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.digest(repair.repair(repair.damage(df))).collect()}
    want = {conv: by_hand(mine) for conv, mine in damaged_by_hand(rows).items()}
    assert got == want
    assert any(not mine for mine in damaged_by_hand(rows).values())


def test_repair_of_the_table(spark):
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == {conv: by_hand(mine) for conv, mine in damaged_by_hand(rows).items()}


def test_repair_of_long_and_empty(spark):
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    n = 4000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("x" * 2000), F.col("id").cast("string"), F.lit(".")).alias("text"))
    r = repair.digest(repair.repair(df)).first()
    assert (r["cost"], r["audit"]) == (n // 2, "KR" * (n // 2)) and r["duplicate"] == 0
    same = df.withColumn("text", F.lit("same.")).withColumn("turn", F.lit(0))
    r = repair.digest(repair.repair(same)).first()
    assert r["duplicate"] == n - 1 and r["audit"] == "D" * n


# --- archives -------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, size int, key string"
ROWS = [
    (5, "http://a/1", "same", 1, "k"), (2, "http://a/2", "same", 1, "k"), (2, "http://a/2", "same", 1, "k"), (None, None, "same", 1, "k"),
    (7, "http://a/ü\r\nX: y", None, None, None), (8, "http://b", "", 1, "k"), (9, "http://b", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\né", 1, "k"), (10, "http://b", "long é " * 200_000, 1, "k"),
]


def digest_of(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def archive(spark, rows=ROWS, **options):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.revisits(spark.createDataFrame(rows, PAGES), options.pop("least_bytes", 0)), path, **options)
    return path


def test_archive_round_trip(spark):
    x = warc.read(spark, archive(spark), verify="true").collect()
    assert len(x) == len(ROWS)
    got = Counter((int(r["record_id"].split(":")[2] or -1), r["record_type"], r["payload_digest"], r["payload_bytes"], int(r["refers_to"].split(":")[2]) if r["refers_to"] else None) for r in x)
    size = lambda t: len((t or "").encode())
    want = Counter()
    for p, _, t, *_ in ROWS:
        first = {"same": 2, None: 7, "": 7}.get(t)
        again = first is not None and (p != first or want[(p, "response", digest_of(t), size(t), None)] > 0)
        want[(-1 if p is None else p, "revisit" if again else "response", digest_of(t), size(t), first if again else None)] += 1
    assert got == want
    for r in x:
        if r["record_type"] == "response":
            assert digest_of(bytes(r["payload"]).decode()) == r["payload_digest"]
        else:
            assert r["payload"] is None
    assert {r["target_uri"] for r in x} == {None, "http://a/1", "http://a/2", "http://a/ü%0D%0AX: y", "http://b"}


def test_archive_threshold_pushdown_and_cuts(spark):
    path = archive(spark, least_bytes=5, partition_bytes=64)
    x = warc.read(spark, path, partition_bytes=64)
    assert x.where("record_type = 'revisit'").count() == 0 and x.rdd.getNumPartitions() >= 4
    hit = warc.read(spark, path).where("record_type in ('response') and target_uri like 'http://a%' and content_length > 10")
    assert "Filter (" not in hit._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["target_uri"] for r in hit.collect()) == ["http://a/1", "http://a/2", "http://a/2", "http://a/ü%0D%0AX: y"]


def test_payloads_of_unwanted_records_are_not_inflated():
    data = b"".join(warc.member(warc.record(f"urn:page:{i}", "response", None, None, bytes([i]) * 300_000, "d"), 1) for i in range(4))

    class File:
        def __init__(self):
            self.at, self.read_bytes = 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            out = data[self.at : self.at + n]
            self.at += len(out)
            return out

    reader = warc.WarcReader({"path": "x"})
    reader.tests = [warc.EqualTo(("record_id",), "urn:page:3")]
    source, members = warc.Input(File(), 0, len(data)), []
    while source.at < len(data):
        members.append(warc.Member(source))
        found = reader.one(members[-1])
    assert found[-1] == b"\3" * 300_000 and source.at == len(data)
    assert not any(m.inflate.eof for m in members[:3])


def test_foreign_archives(spark, tmp_path):
    recs = [warc.record(f"urn:page:{i}", "response", f"http://x/{i}", None, f"page {i}\r\n\r\n".encode() * i, "d") for i in range(5)]
    recs.insert(2, b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: text/plain\r\nContent-Length: 9\r\n\r\nWARC/1.0\n\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(b"".join(recs))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in recs))
    (tmp_path / "ignored.txt").write_bytes(b"no archive")
    x = warc.read(spark, f"file://{tmp_path}", verify="true")
    assert x.count() == 12 and x.where("record_type = 'response'").count() == 10
    assert Counter(bytes(r["payload"]) for r in x.where("record_type = 'response'").collect()) == Counter({f"page {i}\r\n\r\n".encode() * i: 2 for i in range(5)})
    bad = recs[1].replace(b"page 1", b"page 2")
    (tmp_path / "a.warc").write_bytes(bad)
    with pytest.raises(Exception, match="another digest"):
        warc.read(spark, f"file://{tmp_path}/a.warc", verify="true").collect()


def test_only_committed_files_are_read(spark):
    path = archive(spark)
    n = warc.read(spark, path).count()
    fs, where = warc.filesystem(path)
    with fs.open_output_stream(f"{where}/part-left.warc.gz", compression=None) as out:
        out.write(warc.member(warc.record("urn:page:99", "response", None, None, b"", "d"), 1))
    assert warc.read(spark, path).count() == n
    warc.write(warc.revisits(spark.createDataFrame([], PAGES)), path)
    assert warc.read(spark, path).count() == n
    assert warc.read(spark, archive(spark, [])).count() == 0


def test_warc_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    first = {}
    for r in sorted(pages, key=lambda r: r["page_id"]):
        first.setdefault(r["html"] or "", r["page_id"])
    want = {(r["page_id"], len((r["html"] or "").encode()), digest_of(r["html"]), "response" if first[r["html"] or ""] == r["page_id"] else "revisit", None if first[r["html"] or ""] == r["page_id"] else first[r["html"] or ""]) for r in pages}
    assert {tuple(r) for r in queries.op12_warc(spark, SF).collect()} == want


# --- variants -------------------------------------------------------------------------------------


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(counts, ratio=10):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root(w)) for w, n in counts.items()}


def table(spark, counts):
    return spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, len string")


def test_variants_against_brute_force(spark):
    rnd = random.Random(4)
    words = {"".join(rnd.choice("aab") for _ in range(rnd.randint(1, 9))) for _ in range(300)}
    words |= {"".join(rnd.choice("éaz") for _ in range(n)) for n in (15, 16, 17, 18, 63, 64, 65, 66, 200) for _ in range(3)}
    for w in [w for w in words if len(w) > 12]:
        i = rnd.randrange(len(w))
        words |= {w[:i] + "ñ" + w[i + 1 :], w[:i] + "ñ" + w[i:], w[:i] + w[i + 1 :]}
    counts = {w: rnd.choice([2, 3, 25, 25, 400, 5000, 60_000]) for w in words if w}
    got = {tuple(r) for r in variants.variants(table(spark, counts)).collect()}
    assert got == variants_by_hand(counts)
    assert any(r[3] and r[3] != r[5] for r in got)
    assert variants.variants(table(spark, counts).limit(0)).count() == 0


def test_word_counts(spark, odd_docs):
    rnd = random.Random(5)
    rows = [(i if i % 7 else None, " ".join("".join(rnd.choice("ABcÉé×d-") for _ in range(rnd.randint(5, 9))) for _ in range(30)), "x") for i in range(60)]
    rows += [(99, None, "x"), (98, "", "x"), (97, ("wiederholtes Wort " * 200_000), "x"), (1, rows[1][1], "x")]
    got = {r["word"]: r["n"] for r in variants.word_counts(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()}
    want = Counter()
    for d, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert variants.word_counts(odd_docs).count() > 0


def test_variants_of_the_table(spark):
    got = {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in queries.op13_spelling_variants(spark, SF).collect()}
    counts = {w: n for w, n, *_ in got}
    words = set(counts)
    some = sorted(words)[:: max(1, len(words) // 40)]
    whole = {r[0]: r for r in got}
    for w in some:
        found = [v for v in words if one_apart(w, v)]
        assert whole[w][2] == len(found)
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        assert whole[w][3] == (best if best and counts[best] >= 10 * counts[w] else None)


def test_blocks_end_between_words():
    text = "abc déf-gh" * 50
    for size in (1, 3, 7, 1000):
        assert "".join(variants.blocks(text, size)) == text
        assert [w for p in variants.blocks(text, size) for w in re.findall("[a-zé]+", p)] == re.findall("[a-zé]+", text)

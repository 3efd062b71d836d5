"""Web archive and quality rules against plain versions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallywork.llm import quality_rules as q
from tallywork.llm import warc
from samples import edge_pages, no_pages  # noqa: F401


def test_archive_gives_every_page_back(spark, edge_pages, tmp_path):
    folder = str(tmp_path / "archive")
    warc.archive_pages(edge_pages, folder, least_revisit_bytes=20)
    got = warc.read_archive(spark, folder).collect()
    rows = [(r["page_id"], r["url"], r["html"] or "") for r in edge_pages.collect()]
    least = {}
    for page_id, _, text in rows:
        if len(text.encode()) >= 20 and page_id is not None:
            least[text] = min(page_id, least.get(text, page_id))
    want = []
    for page_id, _, text in rows:
        response = text not in least or page_id == least[text]
        want.append((page_id, "response" if response else "revisit", None if response else least[text],
                     hashlib.sha256(text.encode()).hexdigest(), len(text.encode())))
    have = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"]) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))
    for r in got:
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)$", head).group(1))
        assert len(body) == length + 4 and body.endswith(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and (b"WARC-Refers-To: <urn:uuid:" in head) == (r["record_type"] == "revisit")
        assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]
        if r["record_type"] == "response":
            assert body[:-4].partition(b"\r\n\r\n")[2] == bytes(r["payload"])
    # payloads are stored once
    stored = spark.read.parquet(f"{folder}/payloads")
    assert stored.count() == len({text for _, _, text in rows})


def test_a_damaged_payload_fails_the_read(spark, edge_pages, tmp_path):
    folder = str(tmp_path / "archive")
    warc.archive_pages(edge_pages, folder)
    spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.encode(F.lit("other"), "utf-8")).write.parquet(f"{folder}/p2")
    (tmp_path / "archive" / "payloads").rename(tmp_path / "archive" / "old")
    (tmp_path / "archive" / "p2").rename(tmp_path / "archive" / "payloads")
    with pytest.raises(Exception, match="isn't that of digest"):
        warc.read_archive(spark, folder).select("payload_digest").collect()


def test_empty_archive(spark, no_pages, tmp_path):
    warc.archive_pages(no_pages, str(tmp_path / "archive"))
    assert warc.read_archive(spark, str(tmp_path / "archive")).count() == 0


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(lines), sum(c.isupper() for c in text), text.count("!"))


def test_measures_are_those_of_a_plain_count(edge_pages, spark):
    texts = ["a b c a b c a", "a b", "a\na\n\na b c\na b c", "A!! B## <c> | d " * 20, "x y z x y z " * 3 + "end", "a a a a", "a a a"]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    pages = edge_pages.select("page_id", "html").filter("length(html) < 300 OR html IS NULL").unionByName(
        spark.createDataFrame(rows, "page_id long, html string"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_capitals n_exclamations".split()
    got = sorted(str((r["page_id"], *(r[n] for n in names))) for r in q.measure(pages).collect())
    assert got == sorted(str((r["page_id"], *plain_measures(r["html"]))) for r in pages.collect())


def test_long_text_and_clashing_columns(edge_pages, no_pages):
    assert q.rule_ledger(edge_pages).count() == edge_pages.count()
    assert q.rule_ledger(no_pages).count() == 0


def test_policies_and_ablations(spark):
    good, caps = "plain words of a quiet text that goes on " * 3, ""
    good = " ".join(f"word{i}" for i in range(60))
    caps = " ".join(f"WORD{i}!" for i in range(60))
    pages = spark.createDataFrame([(1, good), (2, caps), (3, "too short"), (4, "A! B!"), (5, None)], "page_id long, html string")
    ledger = q.rule_ledger(pages)
    kept = {r["page_id"]: r["kept"] for r in q.apply_policy(ledger, q.POLICIES[2]).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {r["page_id"] for r in q.apply_policy(ledger, q.POLICIES[1]).filter("kept").collect()} == {1, 2}
    table = {r["rule"]: r.asDict() for r in q.ablations(ledger, q.POLICIES[2]).collect()}
    everything = {r["page_id"]: r["failure_bits"] for r in ledger.collect()}
    for rule in q.RULES:
        rest = q.policy_mask([n for n in q.POLICIES[2] if n != rule.name])
        assert table[rule.name]["n_failed"] == sum(b >> rule.bit & 1 for b in everything.values())
        assert table[rule.name]["n_kept_without"] == sum(b & rest == 0 for b in everything.values())
        assert table[rule.name]["n_kept"] == 1


def test_bits_of_other_rules_are_refused(spark, edge_pages):
    other = (*q.RULES[:-1], q.Rule(7, "exclamations", "100 * n_exclamations > 30 * n_words"))
    ledger = q.rule_ledger(edge_pages)
    assert q.apply_policy(ledger, q.POLICIES[2]).count() == edge_pages.count()
    assert q.rules_version(other) != q.rules_version()
    for judged in (q.apply_policy(ledger, ["few_words"], other), q.ablations(ledger, ["few_words"], other)):
        with pytest.raises(Exception, match="other rules"):
            judged.collect()


def test_rebuilt_records_have_the_length_that_their_heads_name(spark, edge_pages, tmp_path):
    folder = str(tmp_path / "archive")
    warc.archive_pages(edge_pages, folder)
    archive = warc.read_archive(spark, folder)
    lengths = warc.record_lengths(archive).collect()
    assert len(lengths) == edge_pages.count() and all(r["record_bytes"] == r["head_says"] for r in lengths)
    want = [(r["page_id"], r["payload_bytes"] if r["record_type"] == "response" else 0) for r in archive.collect()]
    assert sorted(((r["page_id"], r["body_bytes"]) for r in lengths), key=str) == sorted(want, key=str)

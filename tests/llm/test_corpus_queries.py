"""Corpus queries over the small tables: against their SQL, or against brute force where SQL can't say it."""

import base64
import hashlib
import html
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash
from oracle import duck_rows, spark_rows

from sparkcol.llm import queries

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, data_dir, name):
    got, want = spark_rows(queries.QUERIES[name](spark, data_dir)), duck_rows(duck, ORACLES[name])
    assert got == want


def documents(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


def test_op2_is_the_article(spark, duck, data_dir):
    got = {r.page_id: r for r in queries.op2_html_text(spark, data_dir).collect()}
    for page_id, source in duck.execute("SELECT page_id, html FROM pages").fetchall():
        m = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
        inner = re.sub(r"<[^>]{0,12}\Z", "", re.sub(r"<[a-z/!][^>]*>", " ", m[1])) if m else ""
        want = " ".join(html.unescape(inner).split())
        assert got[page_id].text == want and got[page_id].n_chars == len(want)


def brute_sentences(text):
    """Sentences by reading characters: a run of marks and the white space behind it ends one; long ones end at commas and the like."""

    def cut(part, marks):
        out, now, ended = [], "", 0  # ended: 1 inside marks, 2 in the white space behind them
        for c in part:
            if ended and not (c in marks and ended == 1) and not c.isspace():
                out.append(now)
                now, ended = "", 0
            if c in marks:
                if ended == 2:
                    out.append(now)
                    now = ""
                ended = 1 if not (ended == 2 and c.isspace()) else ended
            elif ended:
                ended = 2
            now += c
        return out + [now] if now else out

    for sentence in cut(text, ".!?\n"):
        if len(sentence.split()) <= 20:
            yield sentence
            continue
        for clause in cut(sentence, ",;:"):
            part = ""
            for word in re.findall(r"\s*\S+\s*", clause) if len(clause.split()) > 40 else [clause]:
                part += word
                if len(clause.split()) > 40 and xxhash.xxh3_64(word.strip().lower().encode()).intdigest() % 8 == 0:
                    yield part
                    part = ""
            if part:
                yield part


def test_op4_equals_brute_force(spark, duck, data_dir):
    seen, want = {}, {}
    for doc_id, text, _ in documents(duck):
        pieces = list(brute_sentences(text))
        assert "".join(pieces) == text
        words = [p.lower().split() for p in pieces]
        runs = set()
        for k in range(len(words)):
            for least, at_least in ((2, 25), (1, 50)):
                e = next((e for e in range(k + least, len(words) + 1) if sum(map(len, words[k:e])) >= at_least), None)
                if e and (least == 2 or e - k < 2):
                    runs.add((k, e))
            k = next((j for j in range(k - 1, -1, -1) if sum(map(len, words[j : k + 1])) >= 25), None), k + 1
            if k[0] is not None:
                runs.add(k)
        if not runs and any(words):
            runs = {(0, len(words))}
        gone = set()
        for k, e in sorted(runs):
            if seen.setdefault(tuple(map(tuple, words[k:e])), (doc_id, k)) != (doc_id, k):
                gone.update(range(k, e))
        want[doc_id] = ("".join(p for j, p in enumerate(pieces) if j not in gone).rstrip() if gone else text, len(pieces), len(gone))
    assert {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in queries.op4_substring_dedup(spark, data_dir).collect()} == want


def test_op5_equals_tiktoken(spark, duck, data_dir):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op5_bpe(spark, data_dir).collect()}
    for doc_id, text, _ in documents(duck):
        ids = encoding.encode_ordinary(text)
        r = got[doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op6_identifies_held_out_languages(spark, duck, data_dir):
    got = {r.doc_id: r for r in queries.op6_language_id(spark, data_dir).collect()}
    rows = documents(duck)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = [got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out and lang]
    assert sum(held) / len(held) >= 0.95 and all(0 <= r.score <= 1 for r in got.values())


def test_op8_ranks_held_out_labels(spark, duck, data_dir):
    got = {r.doc_id: r for r in queries.op8_quality_model(spark, data_dir).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for i, r in got.items())
    labels = duck.execute("SELECT doc_id, quality FROM labels").fetchall()
    good = [got[i].score for i, q in labels if q == 1 and got[i].held_out]
    bad = [got[i].score for i, q in labels if q == 0 and got[i].held_out]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) >= 0.9


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    counts = Counter(b for h in hashes for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in counts.items() if 2 * n > len(hashes))


def brute_components(prints):
    """Smallest id reachable, from (id, fingerprint) pairs, by all pairs."""
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in prints}


def test_op10_equals_brute_force(spark, duck, data_dir):
    prints = [(i, brute_fingerprint(t)) for i, t, _ in documents(duck)]
    want = brute_components(prints)
    got = {r.doc_id: r for r in queries.op10_simhash(spark, data_dir).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == dict(prints)
    assert {i: r.component_id for i, r in got.items()} == want and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got.values())

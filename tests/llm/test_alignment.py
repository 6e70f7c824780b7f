"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import documents, make_docs
from trackml.llm import alignment, queries

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path(), queries.piece_model_path()


@pytest.fixture(scope="module")
def plain(paths):
    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    letters = alignment._byte_letters()

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return [(e - len(p), e) for p, e in zip(parts, ends)]

    def one(text):
        """n_a, n_b, groups, and links with their number, or None."""
        if not text:
            return None
        raw = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                   else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return None
        at_a, at_b = spans(parts_a), spans(parts_b)
        groups, links = [], Counter()
        i = j = 0
        for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            k, m = i, j
            while k < len(at_a) and at_a[k][1] <= end:
                k += 1
            while m < len(at_b) and at_b[m][1] <= end:
                m += 1
            groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            for x in range(i, k):
                for y in range(j, m):
                    if max(at_a[x][0], at_b[y][0]) < min(at_a[x][1], at_b[y][1]):
                        links[ids_a[x], ids_b[y]] += 1
            i, j = k, m
        return len(ids_a), len(ids_b), groups, links

    def corpus(texts):
        found = [one(t) for t in texts]
        count = Counter(p for f in found if f for p in f[3])
        highest = Counter()
        for (x, _), n in count.items():
            highest[x] = max(highest[x], n)
        return [(f[0], f[1], len(f[2]), sum(f[3].values()),
                 sum(n for p, n in f[3].items() if count[p] == highest[p[0]]),
                 sum(n * count[p] for p, n in f[3].items()),
                 hashlib.sha256(";".join(f[2]).encode()).hexdigest())
                if f else (0, 0, 0, 0, 0, 0, "") for f in found]
    return corpus


def got(df):
    return [(r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect()]


TEXTS = [None, "", " ", "a", "a<|endoftext|>b", "<s> </s> <unk> <0x0A>", "x▁y", "a  b\n\n c ",
         "don't  we'll", "中文 😀 x", "é́ ﬁ   　 x", "﻿a\x00b\x1c c\r\n d",
         "word " * 3000, "nospace" * 2000, "\n" * 50, "of the and"]


def test_equals_plain_on_traps(spark, paths, plain):
    rows = list(enumerate(TEXTS)) + [(3, "a"), (3, "another text"), (None, "of the and")]
    docs = make_docs(spark, rows).selectExpr(
        "*", "1 as block", "2 as n_links", "'x' as pairs").repartition(3)
    want = [(d, *w) for (d, _), w in zip(rows, plain([t for _, t in rows]))]
    assert sorted(got(alignment.align(docs, *paths)), key=repr) == sorted(want, key=repr)


def test_equals_plain_on_documents(spark, paths, plain):
    rows = documents("sf0.001")
    want = [(d, *w) for (d, _), w in zip(rows, plain([t for _, t in rows]))]
    assert sorted(got(queries.op13_alignment(spark, "/root/testdata/sf0.001"))) == sorted(want)


def test_small_blocks_and_segments_give_the_same(spark, paths, plain):
    texts = [t for _, t in documents("sf0.001")][:60] + TEXTS
    own = alignment.aligner(*paths)
    for t in filter(None, texts):
        cut = alignment.segments(t, 40)
        assert "".join(cut) == " " + t and all(re.match(" ", c) for c in cut)
        whole, parts = own.texts([t])[0], [own.texts([c[1:]])[0] for c in cut]
        if None in parts or any(c == " " for c in cut):
            continue
        assert whole.groups == ";".join(p.groups for p in parts)
        assert whole.pairs.tolist() == [x for p in parts for x in p.pairs.tolist()]


def test_block_lists(paths):
    own = alignment.aligner(*paths)
    rows = [alignment._row(i, f) for i, f in enumerate(own.texts(["of the and", "", "the of"]))]
    block = alignment._block(7, rows)
    pairs = np.frombuffer(block["pairs"][0].as_py(), np.int64)
    docs = np.frombuffer(block["docs"][0].as_py(), np.int64)
    for i, r in enumerate(rows):
        raw, n = block["links"][i].as_py(), block["n_pairs"][i].as_py()
        at, links = alignment._unpacked(raw, n)
        assert pairs[at].tolist() == r[5].tolist() and links.tolist() == r[6].tolist()
    assert docs.sum() == sum(len(r[5]) for r in rows) and block["pairs"][1].as_py() is None


def test_empty_table(spark, paths):
    assert alignment.align(make_docs(spark, []), *paths).collect() == []


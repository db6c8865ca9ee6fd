"""Token alignment against a brute-force version that encodes whole texts and counts pairs in dictionaries."""

import hashlib
import random
from collections import Counter

import pytest

from plumbline.llm import queries, token_alignment
from plumbline.llm.token_alignment import TOKENIZER_A, TOKENIZER_B

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """[(doc_id, *NAMES)] of [(doc_id, text)], text by text and token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(TOKENIZER_A), sentencepiece.SentencePieceProcessor(model_file=TOKENIZER_B)
    a.encode_special_tokens = True
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x]
    of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    found = []
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [bytes(of[c] for c in a.id_to_token(k)) for k in ids_a]
        raw_b = [bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            found.append((doc_id, [], Counter(), 0, 0))
            continue
        groups, left, right = [], list(zip(ids_a, map(len, raw_a))), list(zip(ids_b, map(len, raw_b)))
        while left:
            own, other, x, y = [], [], 0, 0
            while not own or x != y:
                if x <= y:
                    k, n = left.pop(0)
                    own.append(k)
                    x += n
                else:
                    k, n = right.pop(0)
                    other.append(k)
                    y += n
            groups.append((own, other))
        found.append((doc_id, groups, Counter((x, y) for own, other in groups for x in own for y in other), len(ids_a), len(ids_b)))
    held = Counter(p for _, _, links, _, _ in found for p in links)
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups, links, n_a, n_b in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best, count_sum = sum(t for p, t in links.items() if held[p] == best[p[0]]), sum(t * held[p] for p, t in links.items())
        out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), n_best, count_sum, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", *NAMES).collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op12_token_alignment(spark, sf_dir)) == sorted(brute(docs), key=repr)


ODD = [None, "", " ", "  two  blanks ", "a\nb\n\n c\r\nd();\r\n", "one", "one", "a▁b", "\x00\t\x1c\x85x", "１２３ ﬁ 日本語 😀😀", "it's <s> </s> <|endoftext|> <0x41>", "'s 'S don't", "word " * 30_000, "x" * 20_000, " " * 5_000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, white space of all kinds, special tokens, repeated rows, clashing names."""
    rows = [(k, t, 1, "x") for k, t in enumerate(ODD)] + [(5, "one", 1, "x"), (None, "one", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, row long, a string")


@pytest.mark.parametrize("most", [token_alignment.MAX_BROADCAST_PAIRS, 0])
def test_odd_tables(spark, odd, most):
    """Both ways to meet the counts, in a broadcast and in a join."""
    wanted = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert rows_of(token_alignment.align(odd, max_broadcast_pairs=most)) == sorted(wanted, key=repr)
    assert token_alignment.align(odd.where("false"), max_broadcast_pairs=most).count() == 0
    assert token_alignment.align(odd.where("doc_id < 2"), max_broadcast_pairs=most).agg({"n_links": "sum"}).first()[0] == 0


def test_random_texts(spark):
    draw, letters = random.Random(7), "ab c\n\t\r.,'  é▁ß日😀　\xa0\x00<s>1٣\x1c\x85​"
    rows = [(k, "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))) for k in range(500)]
    assert rows_of(token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute(rows), key=repr)

"""Cross-tokenizer alignment against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from codelode.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Summary of (doc_id, text) rows by comparing all byte ranges."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()

    def ranges(parts):
        begin, out = 0, []
        for number, told in parts:
            out.append((number, begin, begin + len(told)))
            begin += len(told)
        return out

    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b, whole = [], [], (" " + (text or "")).encode()
        if text:
            a = [(i, bytes(alphabet[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
            b = [
                (i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode())
                for i in second.encode(text)
            ]
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        a, b = ranges(a), ranges(b)
        links = [(p, q) for p, x, y in a for q, u, v in b if x < v and u < y]
        counts.update(links)
        both = sorted({y for _, _, y in a} & {v for _, _, v in b})
        told, begin = [], 0
        for end in both:
            inside = [",".join(str(i) for i, x, y in side if begin <= x and y <= end) for side in (a, b)]
            told.append("|".join(inside))
            begin = end
        docs.append((doc_id, len(a), len(b), len(both), links, hashlib.sha256(";".join(told).encode()).hexdigest() if told else ""))
    top = Counter()
    for (_, q), n in counts.items():
        top[q] = max(top[q], n)
    return sorted(
        ((i, n, m, g, len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), told) for i, n, m, g, x, told in docs), key=repr
    )


ODD = [
    (1, None), (2, ""), (3, " "), (4, "one"), (5, "  two  spaces\n\nand lines\t"), (6, "a▁b is not kept"), (7, "<|endoftext|> as text <s> </s>"),
    (8, "Ünïcode ß ﬀ 日本語の文 \U0001f600 é"), (9, "nul \x00 byte"), (None, "no id"), (10, "one"), (10, "one"), (11, "x" * 5000), (12, "tail \r\n"),
]


def test_summary_equals_brute_force(spark, documents):
    rng = random.Random(5)
    rows = ODD + [(100 + i, " ".join(rng.choice(["the", "cat", "sät", "überaus", "I'm", "3.14", "\n", "naïve", "tokenization"]) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    for chars in (50, alignment.CHUNK_CHARS):
        got = alignment.alignment_summary(documents(rows, extra=True), A, B, chars=chars).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert sum(r.n_a for r in got) > 500


def test_empty_table_and_texts_without_tokens(spark, documents):
    assert alignment.alignment_summary(documents([]), A, B).count() == 0
    assert [tuple(r)[1:] for r in alignment.alignment_summary(documents([(1, None), (2, "")]), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_tokens_and_links_of_the_alignment(spark, documents):
    rows = alignment.aligned_tokens(documents(ODD), A, B).collect()
    assert len(rows) == len(ODD)
    summary = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links) for r in alignment.alignment_summary(documents(ODD), A, B).collect())
    assert summary == Counter((r.doc_id, len(r.a_ids), len(r.b_ids), len(r.group_ends), len(r.link_a)) for r in rows)
    for r in rows:
        assert r.a_ends[-1:] == r.b_ends[-1:] == r.group_ends[-1:]
        spans = [list(zip([0, *ends], ends)) for ends in (r.a_ends, r.b_ends)]
        met = [(i, j) for i, (x, y) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if x < v and u < y]
        assert sorted(zip(r.link_a, r.link_b)) == met


def test_pieces_of_any_size_give_the_same_overlaps():
    rng = np.random.default_rng(2)
    for _ in range(60):
        end = int(rng.integers(2, 200))
        a, b = (np.unique(np.append(rng.integers(1, end, int(rng.integers(0, end))), end)) for _ in range(2))
        whole = alignment.overlaps(a, b, 1 << 20)
        assert len(whole[0]) == len(a) + len(b) - whole[2].sum()
        for steps in (1, 2, 3, 7):
            assert all((x == y).all() for x, y in zip(whole, alignment.overlaps(a, b, steps)))
            i, j = alignment.diagonal_cuts(a, b, steps)
            assert (np.diff(i) + np.diff(j) <= steps).all() and i[-1] == len(a) and j[-1] == len(b)

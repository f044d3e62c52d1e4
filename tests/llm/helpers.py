"""Plain versions of words and hashes for the tests of this folder."""

import random
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, width=3):
    found = words(lowered(text))
    shingles = [" ".join(found[i : i + width]) for i in range(len(found) - width + 1)]
    if not shingles:
        shingles = [" ".join(found)] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def kept_words(texts, width=13):
    """Texts by id: the words that no window of a smaller id covers."""
    first = {}
    for key in sorted(texts):
        w = words(texts[key])
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), key)
    out = {}
    for key, text in texts.items():
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key:
                gone[i : i + width] = [True] * width
        out[key] = [x for x, g in zip(w, gone, strict=True) if not g]
    return out


def roots(keys, linked):
    """Smallest key reachable from each key."""
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sample_documents():
    """Documents with copies, near copies, shared passages, junk, nulls, empty and long texts."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = sentence(60), sentence(9)
    texts = [None, "", " \t\n", "One", "One two", "<|endoftext|> x<|startoftext|>", "\u00a0 \u2003 İΣ ﬁ 한국 😀"]
    for i in range(120):
        text = sentence(rng.randint(1, 200)) + ".\n" + sentence(rng.randint(0, 60))
        if i % 7 == 0:
            text += " " + passage + " " + sentence(5)
        if i % 5 == 0:
            text = line + "\n" + text + "\n" + line
        if i % 9 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        texts.append(text)
        if i % 6 == 0:
            texts.append(text)
        if i % 8 == 0:
            w = text.split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts.append(sentence(20_000))
    texts.append("x" * 9000 + " " + "ab" * 3000)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    sources = ["a", "a", "a", "b", "c", None]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(sources), len(t or "")) for i, t in zip(ids, texts, strict=True)]
    return rows


def write_tables(spark, folder):
    rows = sample_documents()
    tables = {
        "documents": spark.createDataFrame(rows, DOCS),
        "labels": spark.createDataFrame(
            [(r[0], 0 if "%%%" in (r[1] or "") else 1, 0) for r in rows if r[0] % 2]
            + [(rows[9][0], None, None), (None, 1, 0), (rows[1][0], 1, 0), (rows[1][0], 1, 0)],
            "doc_id long, quality int, toxic int",
        ),
        "conversations": spark.createDataFrame(
            [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 0, "user", "x"),
             (3, 0, None, ""), (2, 1, "assistant", "<|end|> é</s>")],
            "conv_id long, turn long, role string, text string",
        ),
        "embeddings": spark.createDataFrame(
            [(i, [((i * 7 + j * 3) % 11 - 5) / 7 for j in range(8)], 0) for i in range(160)] + [(200, None, 1)],
            "vec_id long, embedding array<float>, label int",
        ),
        "benchmark": spark.createDataFrame(
            [(i, rows[7 * i + 8][1]) for i in range(12)] + [(20, None), (21, "."), (21, "One"), (None, "two ﬁ"), (22, "unknown")],
            "item_id long, text string",
        ),
        "pages": spark.createDataFrame(
            [(1, "u", None), (2, "u", ""), (3, None, "<article><p>A &amp; b.</p></article><nav>x</nav>")],
            "page_id long, url string, html string",
        ),
    }
    for name, df in tables.items():
        df.coalesce(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

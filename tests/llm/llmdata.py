"""Small odd tables: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def prose(rng: random.Random, n: int) -> str:
    syllables = ["an", "the", "ou", "éa", "tion", "ble", "in", "st", "ß", "日本", "er", "x1"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(seed: int = 0) -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars, th, key, id, shard, parts)."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts: list[str | None] = [*base, None, "", " \n\t", "a", "!!!", base[0], base[0], base[1] + " tail"]
    long = prose(rng, 6000)
    texts += [long, long + " more", long[:3000] + " CHANGED " + long[3000:]]
    for k in range(6):  # near copies: one word differs
        w = base[2].split() or ["a"]
        w = w * (60 // len(w) + 1)
        w[k % len(w)] = f"new{k}"
        texts.append(" ".join(w))
    passage = prose(rng, 60)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20), passage, "x" + passage + "\n" + passage]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", "b", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append((None, "a null id " + passage, None, "a", 3))
    rows += [rows[0], rows[0], (None, None, None, None, None)]
    rng.shuffle(rows)
    return [(*r, "th", "key", 7, "shard", "parts") for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, key string, id int, shard string, parts string"


def frame(spark, rows: list[tuple], partitions: int = 3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)

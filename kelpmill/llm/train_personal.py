"""Trains the network of personal.py: python -m kelpmill.llm.train_personal SF_DIR [MINUTES [1 to go on]].

Spans of the sample are labelled by the patterns of their kind and by names that stand in mail headers and contact
names; in a third of the windows names are exchanged for invented ones, so that the network learns places and shapes
and not a list, and in a tenth they are written in lower case. At most DOCUMENTS texts and MESSAGES messages are read, in hash order.
"""

from __future__ import annotations

import re
import sys
import time
from collections import Counter

import numpy as np

from kelpmill.llm import personal as P
from kelpmill.llm import tagger

DOCUMENTS, MESSAGES = 5000, 9000
HANGUL_END = r"(?=님|씨|\s|,|<|\.|:|\)|$|은 |는 |이 |가 |에게|입니다|께| 담당자| 고객)"


class Names:
    def __init__(self, displays: list[str]) -> None:
        self.given, self.sur, self.full = set(), set(), set()
        for d in displays:
            d = d.strip().strip('"')
            if m := re.fullmatch(r"([A-Z][a-z]+) ([A-Z][a-z]+)", d):
                self.given.add(m[1])
                self.sur.add(m[2])
            elif re.fullmatch(r"[가-힣]{3}", d):
                self.full.add(d)
        self.last = {n[0] for n in self.full}
        self.first = {n[1:] for n in self.full}
        k = "(?:" + "|".join(sorted(self.first)) + ")"
        self.hangul = re.compile(rf"(?<![가-힣])(?:[{''.join(sorted(self.last))}]{k}{HANGUL_END}|{k}(?=님))")

    def spans(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        words = [(m.start(), m.end(), m.group()) for m in P.WORD.finditer(text) if not any(a <= m.start() < b for a, b in taken)]
        kind = ["g" if w.capitalize() in self.given and w[0].isupper() else "s" if w.capitalize() in self.sur and w[0].isupper() else "" for _, _, w in words]
        out, i = [], 0
        gap = re.compile(P.GAP + "+")
        while i < len(words):
            s, e, w = words[i]
            if not kind[i]:
                i += 1
                continue
            after = text[e : words[i + 1][0]] if i + 1 < len(words) else None
            if kind[i] == "g" and after is not None and kind[i + 1] == "s" and gap.fullmatch(after):
                out.append((s, words[i + 1][1]))
                i += 2
            elif kind[i] == "s" and after is not None and kind[i + 1] == "g" and re.fullmatch("," + P.GAP, after) and not re.search(r"(?<!\w)[A-Z]\.\s$", text[max(0, s - 4) : s]) and not (i + 2 < len(words) and kind[i + 2] == "s" and gap.fullmatch(text[words[i + 1][1] : words[i + 2][0]])):
                out.append((s, words[i + 1][1]))
                i += 2
            else:
                if kind[i] == "s" and (m := re.search(r"(?<!\w)[A-Z]\.\s$", text[max(0, s - 4) : s])):
                    s -= len(m[0])
                out.append((s, e))
                i += 1
        return out + [m.span() for m in self.hangul.finditer(text)]


def labels(text: str, names: Names) -> list[tuple[int, int, int]]:
    """(start, end, kind number), by rules."""
    out, taken = [], []

    def add(kind: int, s: int, e: int) -> None:
        if not any(a < e and s < b for a, b in taken):
            taken.append((s, e))
            out.append((s, e, kind))

    for m in P.EMAIL.finditer(text):
        add(0, *m.span())
    for m in P.NATIONAL_ID.finditer(text):
        add(2, *m.span())
    for m in P.ADDRESS.finditer(text):
        add(3, *m.span())
    for m in P.PHONE.finditer(text):
        d = re.sub(r"\D", "", m[0])
        before = text[max(0, m.start() - 22) : m.start()]
        if not (m[0][0] in "+(（" or d[0] in "0０" or re.fullmatch(r"[2-9]\d\d[-.]\d{3}[-.]\d{4}", m[0])) or re.search(r"TRK|Invoice|Batch|code|번호 $|Version|version|버전", before) and m[0][0] not in "+(0０" or P.align(text, *m.span(), "phone") is None:
            continue
        add(1, *m.span())
    for s, e in names.spans(text, taken):
        add(4, s, e)
    return sorted(out)


def invented(rng: np.random.Generator, like: str) -> str:
    if "가" <= like[0] <= "힣":
        return "".join(chr(0xAC00 + int(rng.integers(0, 11172 // 28)) * 28 + int(rng.choice([0, 0, 4, 8, 16, 21]))) for _ in like)
    made = "".join(str(rng.choice(list("bdfghjklmnprstvwz"))) + str(rng.choice(list("aeiou"))) + str(rng.choice(["", "n", "r", "l", "s"])) for _ in range(max(1, len(like) // 3)))
    return made.upper() if like.isupper() and len(like) > 1 else made.capitalize()


def main(sf_dir: str, minutes: float = 3.0, go_on: float = 0.0) -> None:
    import duckdb

    q = lambda sql: [r[0] for r in duckdb.sql(sql).fetchall()]
    heads = q(f"SELECT DISTINCT trim(split_part(h, '<', 1)) FROM (SELECT unnest([from_header, to_header]) AS h FROM '{sf_dir}/gmail_messages.parquet')")
    names = Names(heads)
    texts = q(f"SELECT content FROM '{sf_dir}/brain_documents.parquet' WHERE content <> '' ORDER BY hash(record_id) LIMIT {DOCUMENTS}")
    texts += q(f"SELECT body FROM '{sf_dir}/ingest_sms.parquet' WHERE body <> '' ORDER BY hash(record_id) LIMIT {MESSAGES}")
    texts += q(f"SELECT DISTINCT contact_name FROM '{sf_dir}/ingest_sms.parquet' WHERE contact_name <> ''")
    rng = np.random.default_rng(5)
    texts = [texts[i] for i in rng.permutation(len(texts))]
    spans = [labels(t, names) for t in texts]
    seen, inside = Counter(), set()
    for t, found in zip(texts, spans):
        here = set()
        for m in P.WORD.finditer(t):
            w = m.group().lower()
            if any(s < m.end() and m.start() < e for s, e, _ in found):
                inside.add(w)
            else:
                here.add(w)
        seen.update(here)
    common = frozenset(w for w, n in seen.items() if n >= 3 and w not in inside)
    screen = P.Screen(common)
    print(len(texts), "texts,", sum(map(len, spans)), "spans,", len(common), "common words; names", len(names.given), len(names.sur), len(names.full), flush=True)
    held = len(texts) // 10
    examples = []
    for t, found in zip(texts[held:], spans[held:]):
        y = np.zeros(len(t), np.int8)
        for s, e, k in found:
            y[s:e] = 2 * k + 2
            y[s] = 2 * k + 1
        for s, e, *_ in (w for region in P.screened(t, screen) for w in P.windows(*region)):
            text, tags = t[s:e], y[s:e]
            if rng.random() < 0.1:  # names as hasty writers leave them
                for a, b, k in found:
                    if k == 4 and a >= s and b <= e and len(small := text[a - s : b - s].lower()) == b - a:
                        text = text[: a - s] + small + text[b - s :]
            elif rng.random() < 0.33:  # other names
                for a, b, k in reversed([f for f in found if f[0] >= s and f[1] <= e and f[2] == 4]):
                    new = re.sub(r"[^\W\d_]{2,}", lambda m: invented(rng, m[0]), t[a:b])
                    text = text[: a - s] + new + text[b - s :]
                    tags = np.r_[tags[: a - s], [9], np.full(len(new) - 1, 10), tags[b - s :]].astype(np.int8)
            if tags.any() or rng.random() < 0.4:
                examples += [(tagger.encode(text), tags)] * (6 if len(t) < 30 else 1)  # contact names: few, and without context
    print(len(examples), "windows", flush=True)
    p = P.load()[0] if go_on else tagger.init(P.TAGS)
    fast = 0.003 if go_on else 0.012
    opt, began, step, losses = tagger.Adam(p, fast), time.time(), 0, []
    while time.time() - began < minutes * 60:
        opt.rate = fast * max(0.08, 1 - (time.time() - began) / (minutes * 60))
        pick = rng.integers(0, len(examples), 512)
        pick = sorted(pick, key=lambda i: len(examples[i][0]))
        for lo in range(0, 512, 128):
            part = [examples[i] for i in pick[lo : lo + 128]]
            lengths = np.array([len(a) for a, _ in part])
            x, y = np.zeros((len(part), lengths.max()), np.int16), np.zeros((len(part), lengths.max()), np.int8)
            for r, (a, b) in enumerate(part):
                x[r, : len(a)], y[r, : len(a)] = a, b
            loss, g = tagger.gradients(p, x, lengths, y)
            opt.step(g)
            losses.append(loss)
            step += 1
        if step % 200 == 0:
            print(step, round(time.time() - began), "s, loss", round(float(np.mean(losses[-200:])), 3), flush=True)
    np.savez_compressed(P.MODEL, common=np.frombuffer("\n".join(sorted(common)).encode(), np.uint8), **{k: v.astype(np.float16) for k, v in p.items()})
    p, screen = P.load()
    good = Counter()
    for found, want in zip(P.tag_batch(p, texts[:held], screen), spans[:held]):
        a, b = {(s, k) for s, _, k in found}, {(s, P.KINDS[k]) for s, _, k in want}
        for what, rows in (("both", a & b), ("only found", a - b), ("only labelled", b - a)):
            good.update((k, what) for _, k in rows)
    for k in P.KINDS:
        print(k, {w: good[(k, w)] for w in ("both", "only found", "only labelled")})


if __name__ == "__main__":
    main(sys.argv[1], *map(float, sys.argv[2:4]))

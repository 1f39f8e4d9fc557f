"""Plain versions of the corpus operators, over lists of rows, one pair or one line at a time."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard

from lumenframe.llm import langid, mixing, packing, simhash


def language(text, model):
    """(language, margin) of a text by compressing each piece by itself."""
    if not text or not text.strip() or not model:
        return None, 0.0
    data, found = text.lower().encode(), []
    for lang in sorted(model):
        parameters = zstandard.ZstdCompressionParameters(**langid._PARAMETERS)
        content = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        total = 0
        for at in range(0, len(data), 16384):
            total += len(zstandard.ZstdCompressor(dict_data=content, compression_params=parameters).compress(data[at : at + 16384]))
        found.append((total, lang))
    found.sort()
    return found[0][1], (found[1][0] - found[0][0]) / found[1][0] if len(found) > 1 else 1.0


def windows(texts, n=50):
    """{(document, token)} of every token that lies in a window of ``n`` tokens which an earlier one is equal to."""
    seen, found = set(), set()
    for d, text in enumerate(texts):
        words = re.findall("[^ \t\n\r]+", text or "")
        for i in range(len(words) - n + 1):
            window = tuple(words[i : i + n])
            if window in seen:
                found |= {(d, x) for x in range(i, i + n)}
            seen.add(window)
    return found


def deleted_lines(rows, least=30):
    """{(row, line)} that go: long lines met before, and lines of runs of two met before; ``rows`` are texts in order."""
    ones, twos, found = set(), set(), set()
    for r, text in enumerate(rows):
        lines = text.split("\n") if text is not None else []
        for i, line in enumerate(lines):
            if line in ones and len(line) >= least:
                found.add((r, i))
            if i + 1 < len(lines):
                if (line, lines[i + 1]) in twos:
                    found |= {(r, i), (r, i + 1)}
                twos.add((line, lines[i + 1]))
            ones.add(line)
    return found


def without_lines(rows):
    """Texts in order with the lines gone that ``deleted_lines`` names; None in place of those that lose all but white space."""
    gone, found = deleted_lines(rows), []
    for r, text in enumerate(rows):
        if text is None or not any((r, i) in gone for i in range(text.count("\n") + 1)):
            found.append(text)
            continue
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if (r, i) not in gone)
        found.append(kept if kept.strip(" \n\r\t") else None)
    return found


def roots(n, pairs):
    """For each of ``n`` things the least that pairs join it with."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_pairs(texts):
    """All pairs of linked texts, by their bits, one pair at a time."""
    prints, words = simhash.fingerprints(pa.array(texts, pa.string()))
    whole = [[int(p[i]) & (2**64 - 1) for p in prints] for i in range(len(texts))]
    found = []
    for i in range(len(texts)):
        for j in range(i):
            if not words[i] or not words[j]:
                continue
            far = [a ^ b for a, b in zip(whole[i], whole[j])]
            parts = [(x >> s & 0xFFFFFFFF).bit_count() for x in far[: simhash.TABLES] for s in (0, 32)]
            if min(parts) <= 1 and sum(parts) <= simhash.DISTANCE and sum(x.bit_count() for x in far[simhash.TABLES :]) <= simhash.VERIFY_DISTANCE:
                found.append((j, i))
    return found


def mixed(rows, weights):
    """Ids let through, in order, of (id, source, text)."""
    tokens = {i: len(re.findall("[^ \t\n\r]+", text or "")) for i, _, text in rows}
    queue = sorted(rows, key=lambda r: (hashlib.md5(f"17:{r[0]}".encode()).hexdigest(), r[0]))
    sums, finish = {}, []
    for i, source, _ in queue:
        sums[source] = sums.get(source, 0) + tokens[i]
        finish.append((sums[source] / weights.get(source, 1.0), hashlib.md5(f"17:{i}".encode()).hexdigest(), i))
    past, found, budget = 0, [], int(mixing.BUDGET_SHARE * sum(tokens.values()))
    for _, _, i in sorted(finish):
        past += tokens[i]
        if past <= budget:
            found.append(i)
    return found


def packed(sizes, tiers=packing.TIERS):
    """(tier, window, offset) of pieces, with plain lists: best fit, longest first; then gaps, smallest first, take the longest shorter piece that fits."""
    found = [None] * len(sizes)
    left = {t: [i for i in range(len(sizes)) if min(x for x in tiers if x >= sizes[i]) == t] for t in tiers}
    for t in sorted(tiers, reverse=True):
        room = []
        for i in sorted(left[t], key=lambda i: (-sizes[i], i)):
            fits = [(r, w) for w, r in enumerate(room) if r >= sizes[i]]
            w = min(fits)[1] if fits else len(room)
            if not fits:
                room.append(t)
            found[i] = (t, w, t - room[w])
            room[w] -= sizes[i]
        for shorter in sorted((s for s in tiers if s < t), reverse=True):
            for r, w in sorted((r, w) for w, r in enumerate(room)):
                while fits := [i for i in left[shorter] if sizes[i] <= room[w]]:
                    i = max(fits, key=lambda i: (sizes[i], -i))
                    left[shorter].remove(i)
                    found[i] = (t, w, t - room[w])
                    room[w] -= sizes[i]
    return found


def mulaw(byte):
    """One sample by the bits of the code: sign, three of the segment, four of the step."""
    u = byte ^ 0xFF
    size = (2 * (u & 15) + 33 << (u >> 4 & 7)) - 33
    return -4 * size if u & 128 else 4 * size


def alaw(byte):
    u = byte ^ 0x55
    segment, step = u >> 4 & 7, u & 15
    size = 2 * step + 1 if not segment else 2 * step + 33 << segment - 1
    return 8 * size if u & 128 else -8 * size

"""Plain Python versions of language evidence, importance weights and near-duplicate groups, row by row."""

import math
import re
import zlib
from collections import Counter, defaultdict

BUCKETS_LANGUAGE, BUCKETS_QUALITY = 1 << 13, 1 << 16
TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.IGNORECASE | re.DOTALL)


def trigrams(text):
    shown = [c if "a" <= c <= "z" or (0xC0 <= ord(c) and ord(c) not in (0xD7, 0xF7) and not 0x2000 <= ord(c) < 0x2C00) else " " for c in text.lower()]
    line = " " + re.sub(" +", " ", "".join(shown)) + " "
    for x, y, z in zip(line, line[1:], line[2:]):
        if y != " ":
            key = (ord(x) * 0x1F123BB5 + ord(y) * 0x5BD1E995 + ord(z) * 0x2545F491) & 0x7FFFFFFF
            yield ((key ^ (key >> 15)) * 0x2C1B3C6D >> 12) & (BUCKETS_LANGUAGE - 1)


def languages(rows):
    """key -> (language, posterior, text_language, declared, accepted) of rows (key, text, declared or None, host, suffix); keys are distinct."""
    texts = {k: list(trigrams(TAGS.sub(" ", t or ""))) for k, t, *_ in rows}
    counts = defaultdict(Counter)
    for k, _, said, *_ in rows:
        if said:
            counts[said].update(texts[k])
    names = sorted(l for l in counts if counts[l])
    every = [*names, "und"]

    def log_share(l, g):
        return -math.log(BUCKETS_LANGUAGE) if l == "und" else math.log((counts[l][g] + 0.5) / (counts[l].total() + 0.5 * BUCKETS_LANGUAGE))

    text_ll, guess = {}, {}
    for k, grams in texts.items():
        text_ll[k] = [sum(log_share(l, g) for g in grams) * min(len(grams), 60) / max(len(grams), 1) for l in every]
        guess[k] = every[max(range(len(every)), key=lambda i: (text_ll[k][i], -i))] if grams else "und"
    declared = {k: said if said in names else None for k, _, said, *_ in rows}
    pairs = Counter((guess[k], declared[k]) for k in texts if texts[k])
    by_all, by_suffix, by_host = Counter(), defaultdict(Counter), defaultdict(Counter)
    for k, _, _, host, suffix in rows:
        by_all[guess[k]] += 1
        by_suffix[suffix][guess[k]] += 1
        by_host[host][guess[k]] += 1
    found = {}
    for k, _, _, host, suffix in rows:
        scores = []
        for i, l in enumerate(every):
            base = (by_all[l] + 1) / (by_all.total() + len(every))
            above = (by_suffix[suffix][l] + 20 * base) / (by_suffix[suffix].total() + 20)
            prior = 1e-3 if l == "und" else (by_host[host][l] + 20 * above) / (by_host[host].total() + 20)
            said = math.log((pairs[l, declared[k]] + 1) / (sum(pairs[l, x] for x in names) + len(names))) if declared[k] else 0.0
            scores.append(text_ll[k][i] + said + math.log(prior))
        top = max(scores)
        best = every[scores.index(top)] if texts[k] else "und"
        sure = 1 / sum(math.exp(s - top) for s in scores) if texts[k] else 0.0
        found[k] = (best, sure, guess[k], declared[k], best != "und" and sure >= 0.5)
    return found


def quality_features(text):
    one = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in re.findall(r"\w+|[^\w\s]+", text)]
    wrap = (1 << 64) - 1
    for w in one:
        yield (w * 0x9E3779B97F4A7C15 & wrap) >> 48
    for v, w in zip(one, one[1:]):
        two = (v * 0x9E3779B97F4A7C15 + w * 0xC2B2AE3D27D4EB4F) & wrap
        yield ((two ^ (two >> 29)) * 0xBF58476D1CE4E5B9 & wrap) >> 48


def sample(docs, labels, half, noise):
    """[(key, log weight, kept)] of docs (key, text); ``half`` and ``noise`` give the half and the Gumbel noise of a key."""
    said = defaultdict(list)
    for k, quality, toxic in labels:
        said[k].append((quality, toxic))
    good = {k for k, v in said.items() if k is not None and min((q for q, _ in v if q is not None), default=0) >= 1 and max((t for _, t in v if t is not None), default=0) < 1}
    texts = [(k, list(quality_features(t or ""))) for k, t in docs]
    raw, target = Counter(), Counter()
    for k, grams in texts:
        raw.update(grams)
        if k in good and half(k):
            target.update(grams)
    n_raw, n_target = raw.total(), target.total()
    share = lambda counts, n, g: (counts[g] + 0.01 * n / BUCKETS_QUALITY + 1e-9) / (n + 0.01 * n + 1e-9 * BUCKETS_QUALITY)
    weights = [(k, sum(math.log(share(target, n_target, g)) - math.log(share(raw, n_raw, g)) for g in grams)) for k, grams in texts]
    held_out = sorted(w for k, w in weights if k in good and not half(k))
    if not held_out:
        return [(k, w, True) for k, w in weights]
    cut = held_out[max(0, math.ceil(0.002 * len(held_out)) - 1)]
    size = sum(w >= cut - 1e-9 for _, w in weights)
    bar = sorted((w + noise(k) for k, w in weights), reverse=True)[size - 1]
    return [(k, w, w + noise(k) >= bar - 1e-9) for k, w in weights]


def first_of_groups(docs, words, least):
    """Keys that stay of docs (key, text) with distinct keys: the least of each group linked by shingles."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[k] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    above = {k: k for k in sets}

    def top(k):
        while above[k] != k:
            k = above[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and least[1] * both >= least[0] * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                above[y] = x
    return {k for k in keys if top(k) == k}

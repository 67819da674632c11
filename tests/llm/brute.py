"""Plain Python versions of the operators, for small tables of (doc_id, text, source)."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, window=50):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1 if doc is not None else 0):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1 if doc is not None else 0):
            if first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def repeated(w, n, times=2):
    c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] >= times for j in range(i, i + n)}


def gram_shares(text):
    w = words(text or "")
    return {n: sum(len(w[i]) for i in repeated(w, n, 2 if n == 5 else 3)) / max(sum(map(len, w)), 1) for n in range(5, 11)}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    text = text or ""
    w = words(text)
    chars = sum(map(len, w))
    seen, again = set(), []
    for line in text.split("\n"):
        if words(line) and line in seen:
            again.append(sum(map(len, words(line))))
        seen.add(line)
    k = len(repeated(w, 3))
    base = len(w) < 50 or 100 * k > 50 * len(w)
    limits = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
    kept = not base and all(v <= limits[n] for n, v in gram_shares(text).items()) and sum(again) / max(chars, 1) <= 0.20
    return len(w), chars, len(re.findall(r"[#*$%&|<>]", text)), len(again), k, base, kept


def simhash(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(rows):
    """Fingerprint and least reachable id of every row."""
    prints = [simhash(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        g = find(i)
        if doc is not None and (least.get(g) is None or doc < least[g]):
            least[g] = doc
    return [(doc, f"{prints[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)]


def masked(line, constants=3):
    tokens = words(line)
    mask = ["<*>" if re.search("[0-9]", t) else t for t in tokens]
    return tuple(mask if sum(t != "<*>" for t in mask) >= constants else tokens)


def line_dedup(rows, depth=3, similarity=0.7, min_docs=3, min_tokens=3):
    """The texts without recurring lines, by row."""
    docs = defaultdict(set)
    for doc, text in rows:
        for t in {masked(x) for x in (text or "").split("\n")}:
            if len(t) >= min_tokens:
                docs[t].add((doc is None, doc if doc is not None else 0, text or ""))
    leaves = defaultdict(list)
    for t in docs:
        leaves[len(t), t[:depth]].append(t)
    templates = defaultdict(set)  # a line is a template of its own, and may belong to one led by another
    rank = lambda t: (len(docs[t]), hashlib.md5(" ".join(t).encode()).hexdigest())
    for leaf, ts in leaves.items():
        if len(set().union(*(docs[t] for t in ts))) < min_docs:
            continue
        keys = defaultdict(list)
        for t in ts:
            templates[t].add((leaf, t))
            tail = t[depth:]
            pieces = math.floor(len(tail) * (1 - similarity) + 1e-9) + 1
            for i in range(pieces if tail else 0):
                keys[i, tail[i * len(tail) // pieces : (i + 1) * len(tail) // pieces]].append(t)
        leads = defaultdict(set)
        for group in keys.values():
            for t, lead in itertools.permutations(group, 2):
                known = [(a, b) for a, b in zip(t[depth:], lead[depth:]) if not a == b == "<*>"]
                same = sum(a == b for a, b in known)
                if rank(lead) > rank(t) and same and same >= similarity * len(known):
                    leads[t].add(lead)
        for t, found in leads.items():
            templates[t].add((leaf, max(found, key=rank)))
    owners = defaultdict(set)
    for t, ks in templates.items():
        for k in ks:
            owners[k] |= docs[t]
    out = []
    for doc, text in rows:
        me = (doc is None, doc if doc is not None else 0, text or "")
        keep = []
        for line in (text or "").split("\n"):
            found = [owners[k] for k in templates.get(masked(line), ()) if len(owners[k]) >= min_docs]
            if all(min(o) == me for o in found):
                keep.append(line)
        out.append((doc, text if text is None else "\n".join(keep)))
    return out


def targets(rows, weights=(1, 2, 3), epochs=3):
    """source -> (size, target) from (doc_id, text, source)."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(words(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        free = [s for s in order if s not in capped and size[s]]
        if not free:
            break
        level = (total - sum(epochs * size[s] for s in capped)) / sum(weight[s] for s in free)
        new = {s for s in free if level * weight[s] >= epochs * size[s]}
        if not new:
            break
        capped |= new
    return {s: (size[s], 0.0 if not size[s] else float(epochs * size[s]) if s in capped else level * weight[s]) for s in order}


def mix(rows, seed="mix"):
    """copies of every row of distinct (doc_id, text, source)."""
    t = targets(rows)
    out = {}
    for source, (size, target) in t.items():
        own = [r for r in rows if r[2] == source]
        own.sort(key=lambda r: hashlib.md5(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest())
        whole = int(target / size + 1e-12) if size else 0
        before = 0
        for r in own:
            n = len(words(r[1]))
            out[r] = 0 if not n else whole + (before + n / 2 <= target - whole * size)
            before += n
    return out


def jump(key, n):
    """The published jump consistent hash."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def signatures(text, anchors, chain=2):
    text = text or ""
    blanks = " \t\n\x0b\x0c\r.,;:!?\"()[]"
    plain = "".join(" " if c in blanks else c.lower() if "A" <= c <= "Z" else c for c in text)
    w = [x for x in plain.split(" ") if x]
    out = set()
    for p, x in enumerate(w):
        if x in anchors:
            rest = [y for y in w[p + 1 :] if y not in anchors][:chain]
            if len(rest) == chain:
                out.add(hashlib.md5(" ".join([x, *rest]).encode()).hexdigest()[:8])
    return out or {hashlib.md5(text.encode()).hexdigest()[:8]}


def trie(rows, group=100, most=6):
    """Node rows of the prefix trie of (conv_id, turn, role, text); ties of a turn by the digest of role and text."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            convs[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node, who in members.items():
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    return [
        (who[0], len(node), members[node[:-1]][0] if node else None, len(who), children[node], leaves[node], saved[node], sha(",".join(str(c) for c in who if len(built[c]) == len(node))))
        for node, who in members.items()
    ]


def merkle(rows, fan=3):
    """Manifest rows of (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))

    def build(nodes):
        tree = [nodes]
        while len(tree[-1]) > 1:
            tree.append([sha("".join(tree[-1][i : i + fan])) for i in range(0, len(tree[-1]), fan)])
        return tree

    def climb(tree, i, node):
        proof = []
        for level in tree[:-1]:
            run = range(i - i % fan, min(i - i % fan + fan, len(level)))
            proof += [level[j] for j in run if j != i]
            node = sha("".join(node if j == i else level[j] for j in run))
            i //= fan
        return proof, node

    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: build([leaf(r) for r in sources[s]]) for s in order}
    top = build([trees[s][-1][0] for s in order]) if order else []
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(sources[s]):
            seen = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                seen = (*r[:4], r[4].replace("\n", ""))
            inner, node = climb(trees[s], i, leaf(seen))
            outer, node = climb(top, k, node)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(inner + outer)), node, node == top[-1][0]))
    return out


def five_grams(text):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(x, y, least=0.8):
    return len(x & y) >= least * len(x | y)


def one_of_similar(rows):
    """The least id of each component of texts whose five-grams are alike; ids differ."""
    sets, group = [five_grams(t) for _, t in rows], [d for d, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return sorted(set(group))

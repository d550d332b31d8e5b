"""The operators' results in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LAST = (1 << 63) - 1
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def kept_words(rows: list[tuple[int | None, str | None]], width: int = 13) -> list[tuple]:
    """doc_id, words, removed words, kept text."""
    first: dict[tuple, int] = {}
    for doc_id, text in rows:
        own = words(text)
        for i in range(len(own) - width + 1):
            window = tuple(own[i : i + width])
            first[window] = min(first.get(window, LAST), LAST if doc_id is None else doc_id)
    found = []
    for doc_id, text in rows:
        own = words(text)
        gone = [False] * len(own)
        for i in range(len(own) - width + 1):
            if first[tuple(own[i : i + width])] < (LAST if doc_id is None else doc_id):
                gone[i : i + width] = [True] * width
        found.append((doc_id, len(own), sum(gone), b" ".join(w for w, g in zip(own, gone, strict=True) if not g).decode()))
    return found


def measures(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    own = words(text)
    grams = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    uses = Counter(grams)
    covered = {p for i, g in enumerate(grams) if uses[g] > 1 for p in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
    return len(own), sum(len(w.decode()) for w in own), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered), failed


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed([int(c) for c in digits])):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def shingles(text: str | None, width: int = 5) -> frozenset:
    own = (text or "").encode().translate(LOWER).split()
    if len(own) < width:
        return frozenset([tuple(own)] if own else [])
    return frozenset(tuple(own[i : i + width]) for i in range(len(own) - width + 1))


def near_components(rows: list[tuple[int | None, str | None]], percent: int = 75) -> list[tuple]:
    """doc_id, n_shingles, component_id by comparing all rows that share a shingle."""
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    holders = defaultdict(list)
    for k, own in enumerate(sets):
        common = Counter(j for gram in own for j in holders[gram])
        for j, both in common.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                parent[root(k)] = root(j)
        for gram in own:
            holders[gram].append(k)
    smallest: dict[int, int] = {}
    for k, (doc_id, _) in enumerate(rows):
        smallest[root(k)] = min(smallest.get(root(k), LAST), LAST if doc_id is None else doc_id)
    named = [smallest[root(k)] for k in range(len(rows))]
    return [(doc_id, len(sets[k]), None if named[k] == LAST else named[k]) for k, (doc_id, _) in enumerate(rows)]


def edit_distance_within(item: str, text: str) -> int:
    """The smallest edit distance of the item to any part of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        before, row[0] = row[0], 0
        for j, d in enumerate(item, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        best = min(best, row[-1])
    return best


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def merkle(rows: list[tuple]) -> list[tuple]:
    """doc_id, leaf, subroot, root, proof digest, siblings of each (doc_id, source, lang, n_chars, text)."""
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(digests: list[str]) -> tuple[str, list[list[str]]]:
        proofs: list[list[str]] = [[] for _ in digests]
        nodes, below = list(digests), [[k] for k in range(len(digests))]
        while len(nodes) > 1:
            merged, held = [], []
            for k in range(0, len(nodes), 2):
                pair = nodes[k : k + 2]
                for j, node in enumerate(pair):
                    for member in below[k + j]:
                        proofs[member].append("".join(pair[1 - j : 2 - j]) if len(pair) == 2 else "")
                merged.append(digest("".join(pair)))
                held.append([m for b in below[k : k + 2] for m in b])
            nodes, below = merged, held
        return nodes[0], proofs

    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append((row[0], digest("".join(map(mark, row)))))
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    tops, own = [], []
    for name in names:
        by_lang[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        top, proofs = tree([leaf for _, leaf in by_lang[name]])
        tops.append(top)
        own.append(proofs)
    if not tops:
        return []
    root, upper = tree(tops)
    return [
        (doc_id, leaf, tops[k], root, digest("".join(own[k][j] + upper[k])), own[k][j] + upper[k])
        for k, name in enumerate(names) for j, (doc_id, leaf) in enumerate(by_lang[name])
    ]


def aligned(rows: list[tuple[int | None, str | None]], ids_a, bytes_a, ids_b, bytes_b) -> list[tuple]:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups; ids of a text and bytes of an id are given."""
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b = (ids_a(text), ids_b(text)) if text else ([], [])
        want = f" {text}".encode()
        if b"".join(map(bytes_a, a)) != want or b"".join(map(bytes_b, b)) != want:
            a, b = [], []
        ends: list[dict[int, int]] = [{}, {}]
        for own, ids, as_bytes in ((ends[0], a, bytes_a), (ends[1], b, bytes_b)):
            at = 0
            for k, i in enumerate(ids):
                at += len(as_bytes(i))
                own[at] = k
        links, groups, last = [], [], (-1, -1)
        for end, i in ends[0].items():
            if (j := ends[1].get(end)) is not None:
                links.append((a[i], b[j]))
                groups.append("|".join(",".join(map(str, ids[before + 1 : k + 1])) for ids, before, k in ((a, last[0], i), (b, last[1], j))))
                last = i, j
        counts.update(links)
        found.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    best: dict = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (doc_id, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), groups)
        for doc_id, n_a, n_b, n_groups, links, groups in found
    ]


def chat_windows(turns: list[tuple[str, int, bool]], budget: int, history_turns: int, history_tokens: int) -> list[tuple[list, list]]:
    """Repeated and new turns of each window of one conversation; a turn: rendered text, tokens, is it the loss's."""
    system = turns[0] if turns and turns[0][0].startswith("<<SYS>>") else None
    found, at = [], 0
    while at < len(turns):
        head = [system] if system and at else []
        history: list = []
        for k in range(at - 1, max(at - history_turns, 1 if system else 0) - 1, -1):
            if sum(t[1] for t in [turns[k], *history]) > history_tokens or sum(t[1] for t in [*head, turns[k], *history, turns[at]]) > budget:
                break
            history.insert(0, turns[k])
        new = [turns[at]]
        while at + len(new) < len(turns) and sum(t[1] for t in [*head, *history, *new, turns[at + len(new)]]) <= budget:
            new.append(turns[at + len(new)])
        found.append((head + history, new))
        at += len(new)
    return found


def chat_digests(rows: list[tuple]) -> list[tuple]:
    """conv_id, turns, turns digest, loss characters, loss digest of (conv_id, turn, role, text)."""
    by_id = defaultdict(list)
    for conv_id, turn, role, text in rows:
        by_id[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    found = []
    for conv_id, own in by_id.items():
        own.sort()
        loss = "".join(text for *_, role, text in own if role == "assistant")
        found.append((conv_id, len(own), digest("".join(f"{role}\n{text}\n" for *_, role, text in own)), len(loss), digest(loss)))
    return found


def languages(rows, names=("en", "fr", "de", "es")):
    """(language, probability) of every row (text, declared, host, domain, suffix), evidence by evidence."""
    import math

    import numpy as np

    from logclinic.llm import language_id as L
    from logclinic.llm.blocks import mixed

    n = len(names)

    def slots(text):
        found = []
        for word in words(text):
            if not re.search(rb"[0-9]", word):
                padded = b" " + word.decode().lower().encode() + b" "
                found += [padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2] for i in range(len(padded) - 2)]
        return (mixed(np.array(found, np.uint64)) % np.uint64(L.TABLE)).astype(int).tolist() if found else []

    of_row = [slots(row[0]) for row in rows]
    table = [[1] * L.TABLE for _ in range(n + 1)]
    for row, found in zip(rows, of_row, strict=True):
        if row[1] in names:
            for slot in found:
                table[names.index(row[1])][slot] += 1
    totals = [sum(line) for line in table]
    text_part = [[L.TEMPER * sum(math.log(table[k][slot] / totals[k]) for slot in found) for k in range(n + 1)] for found in of_row]
    hosts, domains, everywhere = {}, {}, [0] * n
    for row, part in zip(rows, text_part, strict=True):
        best = max(part[:n])
        if words(row[0]) and best > part[n]:
            read = part.index(best)
            for counts in (hosts.setdefault(row[2], [0] * n), domains.setdefault(row[3], [0] * n), everywhere):
                counts[read] += 1
    top = [(c + 1) / (sum(everywhere) + n) for c in everywhere]
    smoothed = lambda counts, prior: [(c + L.HOST_WEIGHT * p) / (sum(counts) + L.HOST_WEIGHT) for c, p in zip(counts, prior, strict=True)]
    result = []
    for row, part in zip(rows, text_part, strict=True):
        if not words(row[0]):
            result.append(("und", 0.0))
            continue
        prior = smoothed(hosts.get(row[2], [0] * n), smoothed(domains.get(row[3], [0] * n), top))
        logs = [a + math.log(p * (1 - L.UNKNOWN_PRIOR)) for a, p in zip(part[:n], prior, strict=True)] + [part[n] + math.log(L.UNKNOWN_PRIOR)]
        for said, right in ((row[1], L.DECLARED_RIGHT), (L.SUFFIXES.get(row[4]), L.SUFFIX_RIGHT)):
            if said in names:
                logs = [v + math.log(right if x == said else (1 - right) / n) for v, x in zip(logs, (*names, "und"), strict=True)]
        best = max(logs)
        result.append(((*names, "und")[logs.index(best)], 1 / sum(math.exp(v - best) for v in logs)))
    return result

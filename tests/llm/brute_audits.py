"""Plain versions of the conversation repair, the exact duplicates and the filter audit."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from itertools import permutations

ROLE_STEP = {"": "u", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    """(conv, turn, role, text) rows as the contract damages them."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(key.encode()) % 20
        if how == 0:
            continue
        if how == 1:
            text = ""
        if how == 2:
            text = re.sub("[.!?]", "", text)
        if how == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if how == 3 else 1)
    return out


def ordered(rows):
    """One conversation's (turn, role, text) in order."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))


def fault_list(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not kept:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif kept[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append("")
        seen.add((role, text))
    return faults


def cheapest(rows, faults):
    """(cost, audit, lines): least cost, then least audit, by uniform-cost search over all edits.

    Written over sequences of edits, without backward costs: the first goal taken from the queue
    is the cheapest, and of these the least as text.
    """
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, list(lines)
        if (at, state) in done:
            continue
        done.add((at, state))
        step = ROLE_STEP[state]
        name = {"u": "user", "a": "assistant"}[step]
        heapq.heappush(heap, (cost + 3, audit + "I", at, step, (*lines, f"{name}:")))
        if at == len(rows):
            continue
        _, role, text = rows[at]
        heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, lines))
        if faults[at] in ("blank", "duplicate"):
            continue
        extra = 3 if faults[at] == "truncated" else 0
        heapq.heappush(heap, (cost + 3 + extra, audit + "R", at + 1, step, (*lines, f"{name}:{text}")))
        initial = role[:1]
        if initial == step or (initial == "s" and state == ""):
            heapq.heappush(heap, (cost + extra, audit + "K", at + 1, initial, (*lines, f"{role}:{text}")))
    raise AssertionError


def repair_report(rows):
    """The contract's result for undamaged (conv, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role, text))
    out = {}
    for conv, own in convs.items():
        own = ordered(own)
        faults = fault_list(own)
        turns = [turn for turn, _, _ in own if turn is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest(own, faults)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def exact(rows):
    """(doc_id, keep_id, first_id, group_size) of every row, sorted."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    return sorted(((doc, top(ids), low(ids), len(ids)) for ids in groups.values() for doc in ids), key=repr)


def masks(rows):
    """(doc, part, set of failed filters) of (doc, text, source) rows."""
    smallest = {}
    for doc, text, _ in rows:
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    out = []
    for doc, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if doc is not None and doc > smallest[text]:
            fails.add("E")
        out.append((doc, source or "", fails))
    return out


def filter_audit(rows, labels):
    """All result rows: every document is sent through every order, filter by filter."""
    good = {doc for doc, quality, _ in labels if quality == 1 and doc is not None}
    toxic = {doc for doc, _, bad in labels if bad == 1 and doc is not None}
    parts = {}
    for doc, part, fails in masks(rows):
        parts.setdefault(part, []).append((doc, fails))
    out = set()
    for part, docs in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                failing = [d for d in docs if name in d[1]]
                removed_by[name] += len(gone)
                lines.append((
                    part, "".join(order), step, len(left), len(gone), len(failing) - len(gone),
                    sum(d[1] == {name} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), name,
                ))
        out |= {(*line[:-1], removed_by[line[-1]]) for line in lines}
    return out

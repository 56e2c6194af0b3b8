"""Adaptive context-mixing range coder for token ids, over many blocks in lockstep.

A block is coded by itself: its model starts anew, so any block can be read
without the others, and a wrong byte stays inside one block.  Numpy runs one
step of all blocks (lanes) of a segment at a time.

Model of one block.  Order 2 and order 1 each predict one id, the one last
seen after the previous two ids, or the previous one, with a confidence of 0 to
3.  Order 0 predicts two sets: ids that come often (a small table whose entries
must be contradicted before they go) and ids that came lately (a larger one).
The predictions are mixed by frequency rows, one for each state of the order 2
and order 1 predictions, which learn how often each of them is right; the
first that holds the id names it, order 0 with the place in its table, and an id
that none holds follows in plain bits.  All probabilities are whole numbers, so
every machine decodes alike.

Coder: a carryless range coder, 64 bits wide, in 16-bit words, for who holds an
id.  The bits that follow (a place, a plain id) go beside it in 32-bit words, the
first of them last in the block, so both are read without a length.
"""

from __future__ import annotations

import numpy as np

TOTAL_BITS = 12  # of a frequency row
RATE = 4  # a row moves 1/16 of the way to what it has seen
CONTEXT_BITS = 10  # entries of the order 1 and order 2 tables of a block
OFTEN_BITS, LATELY_BITS = 5, 9  # entries of the two order 0 tables
ORDER2, ORDER1, OFTEN, LATELY, PLAIN = range(5)
PAIRS = 16_000  # joined at most
CHOICE, RUN = 1 << 18, 4096  # pairs among which the common ones are found, about, and how many lie together
LEAST_SEEN = 4  # times
_SLOT_BITS = 18
_KINDS = 8  # five in use; a row fills one 16-byte word
_STATES = 32
_LEAST = np.uint64(1 << 32)  # two steps take 24 bits at most
_NONE = np.zeros(0, np.int64)
_FULL = 1 << TOTAL_BITS
_ONES = np.uint64(0x0101010101010101)
_CONTEXTS, _OFTEN, _LATELY = 1 << CONTEXT_BITS, 1 << OFTEN_BITS, 1 << LATELY_BITS
_TOTAL, _LAST, _SHIFT5 = np.uint64(TOTAL_BITS), np.uint64(_FULL - 1), np.uint64(5)
_SHIFT16, _SHIFT32, _SHIFT48, _ONE = np.uint64(16), np.uint64(32), np.uint64(48), np.uint64(1)

_I = np.arange(_KINDS)
_FIRST = np.array([0, 512, 1024, 1536, 2816, 4093, 4094, 4095], np.int16)  # start of each kind in a new row
_TARGET = np.where(_I[None, :] <= _I[:, None], _I[None, :], _FULL - _KINDS + _I[None, :]).astype(np.int16)
_TARGET_ROWS = np.ascontiguousarray(_TARGET).view(np.complex128).ravel()
#: what is added to an entry that stays, by its confidence: after another id, after its own
_SURER = np.array([0, 0, -1, -1, 1, 1, 1, 0], np.int32)
#: the kind by who holds the id: bits of order 2, order 1, often, lately
_KIND_OF = np.array([ORDER2 if m & 1 else ORDER1 if m & 2 else OFTEN if m & 4 else LATELY if m & 8 else PLAIN for m in range(16)])


def id_bits(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def _hash(x: np.ndarray) -> None:
    """In place: ``CONTEXT_BITS`` of each number."""
    x *= np.uint32(0x9E3779B1)
    x >>= np.uint32(32 - CONTEXT_BITS)


def _choose(which: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``np.where`` without a branch for each number."""
    mask = which.astype(np.int32)
    np.negative(mask, out=mask)
    a = a ^ b
    a &= mask
    a ^= b
    return a


def _run(lanes: int, steps: int, bits: int, ids: np.ndarray | None, words: tuple | None):
    """Code ``ids`` (steps x lanes), or decode ``words`` (16-bit words of all lanes, first and last place of each).

    ``take`` and ``put`` that clip are the fastest reads and writes by index numpy has.
    """
    decode = ids is None
    lane = np.arange(lanes)
    rows = np.empty((lanes * _STATES, _KINDS), np.int16)
    rows[:] = _FIRST
    rows = rows.view(np.complex128).ravel()  # a row as one 16-byte item
    at_row = lane * _KINDS
    # order 1, order 2 and the ids that come often: an id and two bits of confidence.  In all tables the lanes lie side
    # by side, so the entries of common ids share cache lines
    seen = np.zeros(lanes * (2 * _CONTEXTS + _OFTEN), np.int32)
    lately = np.zeros(lanes << LATELY_BITS, np.uint16 if bits <= 16 else np.int32)
    base, often0 = np.stack([lane, _CONTEXTS * lanes + lane]), 2 * _CONTEXTS * lanes + lane
    places = np.empty((3, lanes), np.int64)
    contexts = np.empty((2, lanes), np.uint32)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    extra = np.array([0, 0, OFTEN_BITS, LATELY_BITS, bits], np.uint64)  # bits that follow each kind
    held, n_held = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)  # bits on their way
    if decode:
        flat, first, last_place = words
        at, bit_at, pairs = first.copy(), last_place // 2 - 1, flat.view("<u4")
        code = np.zeros(lanes, np.uint64)
        for _ in range(4):
            code = (code << _SHIFT16) | flat.take(at, mode="clip")
            at += 1
        held, n_held = pairs.take(bit_at, mode="clip").astype(np.uint64), n_held + _SHIFT32
        bit_at -= 1
        choice = np.zeros((5, lanes), np.int32)
        ids = np.empty((steps, lanes), np.int32)
    else:
        room, bit_room = steps + 16, steps * bits // 32 + 16
        flat, first = np.zeros(lanes * room, np.uint16), lane * room
        pairs, bit_first = np.zeros(lanes * bit_room, np.uint32), lane * bit_room
        at, bit_at = first.copy(), bit_first.copy()

    every = 2 if bits <= 16 else 1  # steps for which 64 bits have room
    before = last = np.zeros(lanes, np.int32)
    for t in range(steps):
        due = t % every == every - 1 or t == steps - 1
        # predictions
        l32 = last.view(np.uint32)
        contexts[0] = l32
        np.multiply(before.view(np.uint32), np.uint32(60493), out=contexts[1])
        contexts[1] += l32 * np.uint32(40503)
        contexts[1] += np.uint32(1)
        _hash(contexts)
        contexts *= np.uint32(lanes)
        np.add(contexts, base, out=places[:2], casting="unsafe")
        if decode:
            entries = seen.take(places[:2], mode="clip")
        else:
            now = ids[t]
            np.add(often0, (now & (_OFTEN - 1)) * lanes, out=places[2])
            entries = seen.take(places, mode="clip")
        ids_seen, sure = entries >> 2, entries & 3
        state = (sure[0] << 2) | sure[1]
        state += (ids_seen[0] == ids_seen[1]).view(np.int8) << 4
        state *= lanes
        where = lane + state
        whole = rows.take(where, mode="clip")
        row = whole.view(np.int16)
        unit = size >> _TOTAL
        # which of them holds the id
        if decode:
            value = np.minimum((code - low) // unit, _LAST).astype(np.int16)
            below = (row <= value.repeat(_KINDS)).view(np.uint64)
            kind = np.minimum((below * _ONES) >> np.uint64(56), _SHIFT5).astype(np.int64) - 1
        else:
            same = ids_seen == now
            recent = lane + (now & (_LATELY - 1)) * lanes
            found = same.view(np.uint8)
            mask = (lately.take(recent, mode="clip") == now).view(np.uint8) << 1
            mask += found[2]
            mask <<= 1
            mask += found[0]
            mask <<= 1
            mask += found[1]
            kind = _KIND_OF.take(mask, mode="clip")
        k = at_row + kind
        start = row.take(k, mode="clip")
        k += 1
        width = row.take(k, mode="clip") - start
        low += unit * start.astype(np.uint64)
        size = unit * width.astype(np.uint64)
        # the place in an order 0 table, or the plain id, in bits beside the coder
        more = extra.take(kind, mode="clip")
        if decode:
            n_held -= more
            rest = ((held >> n_held) & ((_ONE << more) - _ONE)).astype(np.int64)
            need = np.flatnonzero(n_held < _SHIFT32) if due else _NONE
            if need.size:
                p = bit_at.take(need)
                held.put(need, (held.take(need) << _SHIFT32) | pairs.take(p, mode="clip"))
                bit_at.put(need, p - 1)
                n_held.put(need, n_held.take(need) + _SHIFT32)
            choice[0], choice[1], choice[4] = ids_seen[1], ids_seen[0], rest
            choice[2] = seen.take(often0 + (rest & (_OFTEN - 1)) * lanes, mode="clip") >> 2
            choice[3] = lately.take(lane + (rest & (_LATELY - 1)) * lanes, mode="clip")
            now = choice.take(kind * lanes + lane, mode="clip")
            ids[t] = now
            np.add(often0, (now & (_OFTEN - 1)) * lanes, out=places[2])
            recent = lane + (now & (_LATELY - 1)) * lanes
            entries = np.concatenate([entries, seen.take(places[2:], mode="clip")])
            sure = entries & 3
            same = (entries >> 2) == now
        else:
            held <<= more
            held |= now.view(np.uint32) & ((_ONE << more) - _ONE)
            n_held += more
            need = np.flatnonzero(n_held >= _SHIFT32) if due else _NONE
            if need.size:
                p, n = bit_at.take(need), n_held.take(need) - _SHIFT32
                pairs.put(p, (held.take(need) >> n).astype(np.uint32))
                bit_at.put(need, p + 1)
                n_held.put(need, n)
        # 16 bits leave, or come, where the range became small
        need = np.flatnonzero(size < _LEAST) if due else _NONE
        while need.size:
            lo, sz = low.take(need), size.take(need)
            split = ((lo ^ (lo + sz - _ONE)) >> _SHIFT48) != 0
            if split.any():  # the range holds a carry: keep the part below it
                sz = np.where(split, (~lo + _ONE) & np.uint64((1 << 48) - 1), sz)
            p = at.take(need)
            if decode:
                code.put(need, (code.take(need) << _SHIFT16) | flat.take(p, mode="clip"))
            else:
                flat.put(p, (lo >> _SHIFT48).astype(np.uint16))
            at.put(need, p + 1)
            sz <<= _SHIFT16
            low.put(need, lo << _SHIFT16)
            size.put(need, sz)
            need = need[sz < _LEAST]
        # learn: a row moves towards its kind; an entry becomes surer, less sure, or is replaced
        step = _TARGET_ROWS.take(kind, mode="clip").view(np.int16)
        step -= row
        step >>= RATE
        row += step
        rows.put(where, whole, mode="clip")
        stays = same | (sure > 1)
        entries += _SURER.take((same.view(np.int8) << 2) + sure, mode="clip")
        seen.put(places, _choose(stays, entries, (now << 2) | 1), mode="clip")
        lately.put(recent, now.astype(lately.dtype), mode="clip")
        before, last = last, np.ascontiguousarray(now, np.int32)
    if decode:
        return ids
    for _ in range(4):
        flat[at] = low >> _SHIFT48
        low <<= _SHIFT16
        at += 1
    pairs[bit_at] = (held << (_SHIFT32 - n_held)).astype(np.uint32)
    bit_at += 1
    at += (at - first) & 1
    return [flat[a:b].astype("<u2").tobytes() + pairs[c:d][::-1].astype("<u4").tobytes()
            for a, b, c, d in zip(first, at, bit_first, bit_at)]


def join_pairs(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, pairs): pairs of neighbours seen often become one symbol each, ``base`` and up, so there is less to code.

    Ids are below ``base``.  The pairs are chosen from some runs of the ids;
    the result is exact with any choice.  Symbols stay within 16 bits, so ids
    of more bits are left as they are.
    """
    most = min(PAIRS, (1 << 16) - base)
    none = np.zeros((0, 2), np.int32)
    if most <= 0 or len(ids) < 2:
        return ids, none

    def pairs_of(x: np.ndarray) -> np.ndarray:
        pair = x[:-1].astype(np.uint32)
        pair <<= np.uint32(16)
        pair |= x[1:].view(np.uint32)
        return pair

    step = RUN * -(-len(ids) // CHOICE)
    keys, counts = np.unique(np.concatenate([pairs_of(ids[a:a + RUN + 1]) for a in range(0, len(ids), step)]), return_counts=True)
    order = np.argsort(-counts, kind="stable")[:most]
    keys = keys[order[counts[order] >= LEAST_SEEN]]
    if not len(keys):
        return ids, none
    place = lambda x: ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOT_BITS)).astype(np.int64)
    slot, own = np.unique(place(keys), return_index=True)  # of the keys of one slot, the commonest
    key_at, symbol_at = np.zeros(1 << _SLOT_BITS, np.uint32), np.zeros(1 << _SLOT_BITS, np.int32)
    key_at[0] = 1  # an empty slot holds a key of another slot
    key_at[slot], symbol_at[slot] = keys[own], base + np.arange(len(own))
    symbols, stays, free = ids.copy(), np.ones(len(ids), bool), 0
    for a in range(0, len(ids) - 1, CHOICE):  # as much as the cache holds
        pair = pairs_of(ids[a:a + CHOICE + 1])
        at = place(pair)
        hit = np.flatnonzero(key_at.take(at, mode="clip") == pair)
        if len(hit) and hit[0] + a < free:  # its first id is taken already
            hit = hit[1:]
        i = np.arange(len(hit))  # neighbours overlap: of hits in a row, every other
        begins = np.ones(len(hit), bool)
        begins[1:] = hit[1:] != hit[:-1] + 1
        hit = hit[((i - np.maximum.accumulate(np.where(begins, i, 0))) & 1) == 0]
        symbols[a:].put(hit, symbol_at.take(at.take(hit)))
        stays[a + 1:].put(hit, False)
        free = a + int(hit[-1]) + 2 if len(hit) else free
    return symbols[stays], np.stack([keys[own] >> np.uint32(16), keys[own] & np.uint32(0xFFFF)], 1).astype(np.int32)


def part_pairs(symbols: np.ndarray, base: int, pairs: np.ndarray) -> np.ndarray:
    """The ids that ``join_pairs`` made ``symbols`` of."""
    if not len(pairs):
        return symbols
    table = np.full((base + len(pairs), 2), -1, np.int32)
    table[:base, 0] = np.arange(base)
    table[base:] = pairs
    both = table.view(np.int64).ravel().take(symbols, mode="clip").view(np.int32)
    return both[both >= 0]


def encode(blocks: np.ndarray, bits: int) -> list[bytes]:
    """Bytes of each row of ``blocks`` (lanes x ids); ids are below 2 ** ``bits``, 29 bits at most."""
    return _run(blocks.shape[0], blocks.shape[1], bits, np.ascontiguousarray(blocks.T, dtype=np.int32), None)


def decode(parts: list[bytes], ids_each: int, bits: int) -> np.ndarray:
    """Rows of ``ids_each`` ids, one for each of ``parts``."""
    ends = np.cumsum([-(-len(p) // 4) * 4 for p in parts])
    flat = np.frombuffer(b"".join(p.ljust(-(-len(p) // 4) * 4, b"\0") for p in parts) or bytes(4), "<u2")
    first = np.concatenate([[0], ends[:-1]])
    return np.ascontiguousarray(_run(len(parts), ids_each, bits, None, (flat, first // 2, ends // 2)).T)

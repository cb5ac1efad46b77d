"""Deep-shallow sorting of suffixes: multikey quicksort to a shallow depth, blind tries below it."""

import numpy as np

WORD = 8  # bytes that the quicksort takes as one character
SHALLOW = 2  # such characters


class BlindTrie:
    """Byte strings with their members, ordered by branching bytes; only one whole comparison per insertion."""

    def __init__(self):
        self.root = None  # a leaf (string, members), or a node [depth, {byte: child}]

    def add(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = (text, [member])
            return
        node = self.root
        while type(node) is list:  # blind descent: only branching bytes are looked at
            depth, kids = node
            key = text[depth] if depth < len(text) else -1
            node = kids[key] if key in kids else next(iter(kids.values()))
        other, members = node
        if other == text:
            members.append(member)
            return
        shared = common(other, text)
        new, old = text[shared] if shared < len(text) else -1, other[shared] if shared < len(other) else -1
        parent, link, node = None, None, self.root
        while type(node) is list and node[0] < shared:
            parent, link = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][link]
        if type(node) is list and node[0] == shared:
            node[1][new] = (text, [member])
            return
        branch = [shared, {old: node, new: (text, [member])}]
        if parent is None:
            self.root = branch
        else:
            parent[1][link] = branch

    def leaves(self):
        """Members of equal strings, in the strings' order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
            elif node is not None:
                yield node[1]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def deep_shallow(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of data[start:start+length], and for each such string its class: equal strings share one.

    Strings are at least SHALLOW * WORD long. Members of a class keep their given order.
    """
    n = len(starts)
    order = np.arange(n)
    if not n:
        return order, order
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
    characters = np.ndarray((len(padded) - WORD + 1,), ">u8", padded, strides=(1,))
    first = np.arange(n) == 0  # of a group that is equal so far, by place in the order
    for depth in range(SHALLOW):
        # Of groups with several members only; in them members are sorted by their next character.
        tied = ~(first & np.append(first[1:], True))
        places = np.flatnonzero(tied)
        group = np.cumsum(first)[places]
        who = order[places]
        key = characters[starts[who] + depth * WORD].astype(np.uint64)
        turn = np.lexsort((key, group)) if depth else np.argsort(key, kind="stable")
        order[places] = who[turn]
        key, group = key[turn], group[turn]
        first[places] = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
    heads = np.flatnonzero(first)
    sizes = np.diff(np.append(heads, n))
    text, skip = data.tobytes(), SHALLOW * WORD
    begin, end = (starts + skip).tolist(), (starts + lengths).tolist()
    for head, size in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        trie = BlindTrie()
        for member in sorted(order[head:head + size].tolist()):
            trie.add(text[begin[member]:end[member]], member)
        at = head
        for members in trie.leaves():
            order[at:at + len(members)] = members
            first[at] = True
            first[at + 1:at + len(members)] = False
            at += len(members)
    classes = np.empty(n, np.int64)
    classes[order] = np.cumsum(first) - 1
    return order, classes

"""Plain reference results on small inputs."""

from __future__ import annotations

import numpy as np


def distances(xy: np.ndarray) -> np.ndarray:
    d = xy[:, None, :] - xy[None, :, :]
    return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1])


def components(adjacent: np.ndarray, nodes: np.ndarray) -> dict[int, int]:
    """Smallest connected node per node."""
    label: dict[int, int] = {}
    for start in nodes:
        if start in label:
            continue
        stack, label[start] = [start], start
        while stack:
            for j in np.flatnonzero(adjacent[stack.pop()]):
                if j not in label and j in node_set(nodes):
                    label[j] = start
                    stack.append(j)
    return label


def node_set(nodes: np.ndarray) -> set[int]:
    return set(nodes.tolist())


def dbscan(xy: np.ndarray, eps: float, min_samples: int) -> list[int]:
    near = distances(xy) <= eps
    core = near.sum(1) >= min_samples
    label = [-1] * len(xy)
    nodes = np.flatnonzero(core)
    found = components(near & core[None, :] & core[:, None], nodes)
    order = {c: i for i, c in enumerate(sorted(set(found.values())))}
    for i in range(len(xy)):
        if core[i]:
            label[i] = order[found[i]]
        else:
            reach = [order[found[j]] for j in np.flatnonzero(near[i] & core)]
            label[i] = min(reach) if reach else -1
    return label


def levels(xy: np.ndarray, radii: list[float], min_samples: int, alpha: float) -> set[tuple[int, int, int]]:
    """(level, id, component) of dense points."""
    d = distances(xy)
    core_distance = np.sort(d, axis=1)[:, min_samples]
    out = set()
    for g, r in enumerate(radii):
        dense = core_distance <= r
        nodes = np.flatnonzero(dense)
        found = components((d <= alpha * r) & dense[None, :] & dense[:, None], nodes)
        out |= {(g, int(i), int(c)) for i, c in found.items()}
    return out


def excess_of_mass(rows: set[tuple[int, int, int]], radii: list[float], size: int, n: int) -> list[int]:
    """Outermost most stable clusters over the levels, numbered by smallest point at birth."""
    members: dict[tuple[int, int], set[int]] = {}
    for g, i, c in rows:
        members.setdefault((g, c), set()).add(i)
    big = {k: v for k, v in members.items() if len(v) >= size}
    inverse = [1 / r for r in radii]
    gain = [now - then for now, then in zip(inverse, [inverse[0] ** 2 / inverse[1], *inverse])]

    def grow(g: int, inside: set[int] | None) -> tuple[float, list]:
        """Best choice among the clusters born strictly inside a cluster whose node is at level g - 1."""
        parts = [k for k in big if k[0] == g and (inside is None or big[k] <= inside)]
        if len(parts) == 1:
            return grow(g + 1, big[parts[0]])
        total, chosen = 0.0, []
        for k in parts:
            mass, at = len(big[k]) * gain[g], k
            while True:
                nxt = [m for m in big if m[0] == at[0] + 1 and big[m] <= big[at]]
                if len(nxt) != 1:
                    break
                at = nxt[0]
                mass += len(big[at]) * gain[at[0]]
            inner, inner_chosen = grow(at[0] + 1, big[at])
            if mass >= inner:
                total, chosen = total + mass, [*chosen, k]
            else:
                total, chosen = total + inner, [*chosen, *inner_chosen]
        return total, chosen

    _, chosen = grow(0, None)
    label = [-1] * n
    for place, k in enumerate(sorted(chosen, key=lambda k: (k[1], k[0]))):
        for i in big[k]:
            label[i] = place
    return label


def reachability(xy: np.ndarray, min_samples: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Core distances, and the mutual reachability of all pairs."""
    d = distances(xy)
    core = np.sort(d, axis=1)[:, min_samples]
    return core, np.maximum(np.maximum(core[:, None], core[None, :]), d / alpha)


def hierarchy(xy: np.ndarray, size: int, min_samples: int, alpha: float) -> list[int]:
    """Most stable clusters over the components at every single length, numbered by smallest point."""
    core, reach = reachability(xy, min_samples, alpha)
    rows, cols = np.triu_indices(len(xy), 1)
    order = np.argsort(reach[rows, cols], kind="stable")
    lengths = reach[rows, cols][order]
    positive = np.concatenate([core, lengths])
    shortest = positive[positive > 0].min()
    gain = lambda w: 1 / max(w, shortest)
    whole = [{i} for i in range(len(xy))]
    owner = list(range(len(xy)))
    nodes: dict[frozenset, dict] = {}  # components of at least `size` points with the length at which they arise
    for start, end in zip(*(np.flatnonzero(np.diff(lengths, prepend=-1, append=np.inf))[k:][: None if k else -1] for k in (0, 1))):
        grown = set()
        for k in order[start:end].tolist():
            a, b = owner[rows[k]], owner[cols[k]]
            if a != b:
                whole[a] |= whole[b]
                for i in whole[b]:
                    owner[i] = a
                whole[b] = set()
                grown.add(a)
        for c in {owner[i] for a in grown for i in list(whole[a])[:1]}:
            if len(whole[c]) >= size:
                nodes[frozenset(whole[c])] = {"w": lengths[start]}

    def children(members: frozenset) -> list[frozenset]:
        inside = [m for m in nodes if m < members]
        return [m for m in inside if not any(m < o for o in inside)]

    def best(members: frozenset, born: float) -> tuple[float, list[frozenset]]:
        """Stability of the cluster that begins with this component, and the best choice among it and its parts."""
        mass, at, first = 0.0, members, members
        while True:
            parts = children(at)
            if len(parts) != 1:
                mass += len(at) * gain(nodes[at]["w"])
                break
            mass += (len(at) - len(parts[0])) * gain(nodes[at]["w"])
            at = parts[0]
        stability = mass - len(first) * born
        below = [best(p, gain(nodes[at]["w"])) for p in parts]
        inner, chosen = sum(b[0] for b in below), [c for b in below for c in b[1]]
        return (stability, [first]) if stability >= inner else (inner, chosen)

    at = max(nodes, key=len, default=None)
    while at is not None and len(parts := children(at)) == 1:
        at = parts[0]
    chosen = [c for p in (children(at) if at else []) for c in best(p, gain(nodes[at]["w"]))[1]]
    label = [-1] * len(xy)
    for place, members in enumerate(sorted(chosen, key=min)):
        for i in members:
            label[i] = place
    return label

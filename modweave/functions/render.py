"""Reports of small results: lists, DOT, grids, trees and coloured chains."""

from __future__ import annotations

from modweave.functions.paths import display, middle_cut
from modweave.operators.dag import render_tree

# The two ends of the depth colours, as red, green and blue.
LEAF_COLOR, DEEP_COLOR = (217, 249, 157), (191, 219, 254)
Edges = set[tuple[str, str]]


def quoted(label: str) -> str:
    return '"' + label.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def mixed(low: tuple[int, int, int], high: tuple[int, int, int], share: float) -> str:
    share = min(1.0, max(0.0, share))
    return "#" + "".join(f"{int(a + (b - a) * share + 0.5):02x}" for a, b in zip(low, high, strict=True))


def cycles_text(cycles: list[list[str]], cwd: str = "/", what: str = "modules") -> str:
    """Each cycle with its members."""
    if not cycles:
        return f"No import cycles found between {what}"
    lines = [f"Found {len(cycles)} import cycle{'s' if len(cycles) > 1 else ''} between {what}:"]
    for k, cycle in enumerate(cycles, 1):
        lines += ["", f"Cycle {k} ({len(cycle)} {what}):", *(f"  {display(n, cwd)}" for n in cycle)]
    return "\n".join(lines)


def cycles_dot(cycles: list[list[str]], edges: Edges, name: str = "ModuleCycles", cwd: str = "/") -> str:
    """Nodes of all cycles, and every edge between any two of them."""
    nodes = sorted({n for c in cycles for n in c})
    if not nodes:
        return "// No import cycles found"
    at = {n: f"n{i}" for i, n in enumerate(nodes)}
    lines = [f"digraph {name} {{", "  rankdir=LR;", "  node [shape=box, style=rounded];"]
    lines += [f"  {at[n]} [label={quoted(display(n, cwd))}, color=red, penwidth=2];" for n in nodes]
    lines += [f"  {at[a]} -> {at[b]} [color=red];" for a, b in sorted(edges) if a in at and b in at]
    return "\n".join([*lines, "}"])


# The signs of the two grids: node, lines, arrow heads, corners by quarter, crossing.
ASCII = {"node": "o", "h": "-", "v": "|", "left": "<", "right": ">", "corner": "+", "cross": "+"}
BOX = {"node": "●", "h": "─", "v": "│", "left": "◀", "right": "▶", "tr": "┐", "bl": "└", "cross": "┼"}


def grid(cycle: list[str], edges: Edges, signs: dict[str, str] = ASCII, cwd: str = "/", width: int = 60) -> str:
    """A cycle as a diagonal of nodes (row 2i, column 3i) with the edges drawn between them.

    An edge leaves its node along the row, turns at a corner over or under its target's column and
    ends beside the target. Nodes, heads and corners are never overwritten; crossing lines meet.
    """
    at = {n: (2 * i, 3 * i) for i, n in enumerate(cycle)}
    rows = [[" "] * (3 * len(cycle) + 2) for _ in range(2 * len(cycle) - 1)] if cycle else []
    fixed = {signs[k] for k in signs if k not in ("h", "v", "cross")}

    def put(r: int, c: int, kind: str) -> None:
        now = rows[r][c]
        if now in fixed and not (now == signs["cross"] and kind == "cross"):
            return
        crossing = {now, signs[kind]} == {signs["h"], signs["v"]}
        rows[r][c] = signs["cross"] if crossing else signs[kind]

    for r, c in at.values():
        put(r, c, "node")
    for a, b in sorted(edges, key=lambda e: (at.get(e[0], (0, 0)), at.get(e[1], (0, 0)))):
        if a not in at or b not in at or a == b:
            continue
        (r1, c1), (r2, c2) = at[a], at[b]
        down = r2 > r1
        turn = c2 - 1 if down else c2 + 1  # the column beside the target
        step = 1 if turn >= c1 else -1
        for c in range(c1 + step, turn, step):
            put(r1, c, "h")
        if turn != c1:
            put(r1, turn, ("tr" if down else "bl") if "tr" in signs else "corner")
        for r in range(min(r1, r2) + 1, max(r1, r2)):
            put(r, turn, "v")
        put(r2, turn, "right" if down else "left")
    return "\n".join(f"{''.join(row):<{3 * len(cycle) + 2}} {middle_cut(display(cycle[i // 2], cwd), width) if i % 2 == 0 else ''}".rstrip() for i, row in enumerate(rows))


def top_text(rows: list[tuple[str, int]], cwd: str = "/") -> str:
    return "\n".join(["Top 10 hottest modules:", *(f"{score:>10} {display(p, cwd)}" for p, score in rows[:10])])


def chain_text(chain: list[tuple[str, float]], least: float, middle: float, most: float, cwd: str = "/") -> str:
    """A chain with scores coloured from green over yellow (the middle) to red."""
    lines = []
    for path, score in chain:
        low = score <= middle
        share = (score - least) / (middle - least) if low and middle > least else (score - middle) / (most - middle) if not low and most > middle else 0.0
        color = mixed((0, 200, 0), (220, 220, 0), share) if low else mixed((220, 220, 0), (220, 0, 0), share)
        r, g, b = (int(color[k : k + 2], 16) for k in (1, 3, 5))
        lines.append(f"\x1b[38;2;{r};{g};{b}m{int(score + 0.5):>10}\x1b[0m {display(path, cwd)}")
    return "\n".join(lines)


def coupling_text(title: str, members: list[str], edges: Edges) -> str:
    """Components with their dependencies, dependents, leaf clusters and the groups of depth 0 and 1."""
    from modweave.operators.coupling import analyse

    a = analyse(members, edges)
    if not a.label:
        return f"{title}\nNo declarations found.\n"
    named = lambda pairs: [(a.label[x], a.label[y]) for x, y in pairs]
    by_depth = lambda sign: [a.label[s] for s in sorted(a.label, key=lambda s: (sign * a.depth[s], a.label[s]))]
    tops = {y for _, y in a.edges}
    lines = [title, "Dependents -> Dependencies:", render_tree(named(a.edges), [n for n in by_depth(-1) if n not in {a.label[s] for s in tops}] or by_depth(-1)), ""]
    lines += ["Dependencies -> Dependents:", render_tree([(y, x) for x, y in named(a.edges)], [a.label[s] for s in sorted(a.leaves, key=a.label.get)]), ""]
    first, second = ([a.label[s] for s in side] for side in a.clusters)
    lines += [f"Leaf clusters: A = {', '.join(first) or 'none'}; B = {', '.join(second) or 'none'}", "", "Depth 0-1 groups:"]
    lines += [f"  {', '.join(a.label[s] for s in group)}" for group in a.groups] or ["  none"]
    return "\n".join(lines) + "\n"


def coupling_dot(members: list[str], edges: Edges, shallow: bool = False) -> str:
    """Components coloured by depth; ``shallow`` keeps depth 0 and 1 with the edges from 1 to 0."""
    from modweave.operators.coupling import analyse

    a = analyse(members, edges)
    shown = [s for s in sorted(a.label, key=lambda s: (a.depth[s], a.label[s])) if not shallow or a.depth[s] <= 1]
    deepest = max((a.depth[s] for s in shown), default=0)
    lines = ["digraph Coupling {", "  rankdir=LR;", "  node [shape=box, style=filled];"]
    lines += [f"  c{k} [label={quoted(a.label[s])}, fillcolor={quoted(mixed(LEAF_COLOR, DEEP_COLOR, a.depth[s] / deepest if deepest else 0))}];" for k, s in enumerate(shown)]
    at = {s: k for k, s in enumerate(shown)}
    pairs = [(x, y) for x, y in sorted(a.edges) if x in at and y in at and (not shallow or (a.depth[x], a.depth[y]) == (1, 0))]
    return "\n".join([*lines, *(f"  c{at[x]} -> c{at[y]};" for x, y in pairs), "}"]) + "\n"

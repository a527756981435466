"""The cheapest edits of a run of turns, by iterative deepening.

Roles must read `(s?(ua)+)?` by their initials. Before each turn, an empty turn
of the role that fits may be inserted; the turn is then deleted, kept or given
the role that fits. A depth-first search tries the edits in ASCII order and goes
no further than a bound on the cost, which grows to the least cost that was out
of reach. What a failed state needs at least is kept in a table, for this search
and for the ones with greater bounds. The first accepting path is the answer:
the cheapest one, and the least by letters among those.
"""

from __future__ import annotations

START, SYSTEM, USER, ASSISTANT = range(4)
#: the state after an inserted or reassigned turn, and its role
FITTING = (USER, USER, ASSISTANT, USER)
ROLES = ("", "", "user", "assistant")
#: the states that a kept turn leads to, by state and initial
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
DELETE, INSERT, REASSIGN, TRUNCATED = 3, 2, 2, 1  # costs
#: what a conversation that ends in a state still needs, and its letters
ENDS, TAILS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")


def _edits(initial: str, fault: str) -> list[list[tuple[str, int, int, int]]]:
    """For each state: (letter, cost, turns taken, next state), by letter."""
    more = TRUNCATED if fault == "t" else 0
    table = []
    for state, fitting in enumerate(FITTING):
        edits = [("D", DELETE, 1, state), ("I", INSERT, 0, fitting)]
        if fault in ".t":
            if (state, initial) in KEPT:
                edits.append(("K", more, 1, KEPT[state, initial]))
            edits.append(("R", REASSIGN + more, 1, fitting))
        table.append(edits)
    return table


#: by initial (o for any other) and fault (blank, duplicate, truncated or none)
EDITS = {initial + fault: _edits(initial, fault) for initial in "suao" for fault in "bdt."}
#: what a turn costs whatever the roles
LEAST = {turn: DELETE if turn[1] in "bd" else TRUNCATED if turn[1] == "t" else 0 for turn in EDITS}


def search(turns: list[str], state: int, ends: tuple[int, int, int, int]) -> tuple[int, str, int]:
    """(cost, letters, last state) of the answer for turns, as keys of EDITS, in
    a state. `ends` is what follows costs at least, by the state it begins in;
    the cost includes it."""
    floor = [min(ends)]
    for turn in reversed(turns):
        floor.append(floor[-1] + LEAST[turn])
    floor.reverse()
    failed: dict[tuple[int, int], int] = {}
    bound = floor[0]
    while True:
        path = _dive(turns, state, ends, floor, failed, bound)
        if path is not None:
            return bound, "".join(letter for letter, _ in path), path[-1][1] if path else state
        bound = failed[0, state]


def _dive(turns, state, ends, floor, failed, bound) -> list[tuple[str, int]] | None:
    """The first path of at most that cost as (letter, state), or None. Then every
    state that was reached and its least cost beyond the bound are in `failed`."""
    n = len(turns)
    if not n:
        if ends[state] <= bound:
            return []
        failed[0, state] = ends[state]
        return None
    # position, state, cost left, edits not yet tried, least cost that was out of reach, cost of the edit that led here
    stack = [[0, state, bound, iter(EDITS[turns[0]][state]), 1 << 60, 0]]
    path: list[tuple[str, int]] = []
    while stack:
        frame = stack[-1]
        at, _, left, edits, _, _ = frame
        for letter, cost, taken, after in edits:
            to = at + taken
            need = ends[after] if to == n else max(floor[to], failed.get((to, after), 0))
            if cost + need > left:
                frame[4] = min(frame[4], cost + need)
            elif to == n:
                return [*path, (letter, after)]
            else:
                path.append((letter, after))
                stack.append([to, after, left - cost, iter(EDITS[turns[to]][after]), 1 << 60, cost])
                break
        else:
            failed[at, frame[1]] = frame[4]
            stack.pop()
            if stack:
                path.pop()
                stack[-1][4] = min(stack[-1][4], frame[5] + frame[4])
    return None

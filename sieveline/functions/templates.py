"""Stroke templates of characters: regions that each stroke passes, as a small lookup that a user extends."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

#: The numpad cell of each region.
CELLS = {"TL": 7, "TC": 8, "TR": 9, "ML": 4, "MC": 5, "MR": 6, "BL": 1, "BC": 2, "BR": 3}
#: Strokes of the capital letters, by regions.
CAPITALS = {
    "A": [["TC", "BL"], ["TC", "BR"], ["ML", "MR"]],
    "B": [["TL", "BL"], ["TL", "MR", "BL"]],
    "C": [["TR", "BR"]],
    "D": [["TL", "BL"], ["TL", "MR", "BL"]],
    "E": [["TL", "BL"], ["TL", "TR"], ["ML", "MR"], ["BL", "BR"]],
    "F": [["TL", "BL"], ["TL", "TR"], ["ML", "MR"]],
    "G": [["TR", "MR"], ["MR", "MC"]],
    "H": [["TL", "BL"], ["TR", "BR"], ["ML", "MR"]],
    "I": [["TC", "BC"]],
    "J": [["TR", "BC"]],
    "K": [["TL", "BL"], ["TR", "ML"], ["ML", "BR"]],
    "L": [["TL", "BL"], ["BL", "BR"]],
    "M": [["BL", "TL", "BC"], ["BC", "TR", "BR"]],
    "N": [["TL", "BL"], ["TL", "BR"], ["TR", "BR"]],
    "O": [["TC", "ML", "BC"], ["TC", "MR", "BC"]],
    "P": [["TL", "BL"], ["TL", "MR", "ML"]],
    "Q": [["TC", "ML", "BC"], ["TC", "MR", "BC"], ["MC", "BR"]],
    "R": [["TL", "BL"], ["TL", "MR", "ML"], ["ML", "BR"]],
    "S": [["TR", "BL"]],
    "T": [["TL", "TR"], ["TC", "BC"]],
    "U": [["TL", "BC", "TR"]],
    "V": [["TL", "BC"], ["BC", "TR"]],
    "W": [["TL", "BL"], ["BL", "TC"], ["TC", "BR"], ["BR", "TR"]],
    "X": [["TL", "BR"], ["TR", "BL"]],
    "Y": [["TL", "MC"], ["TR", "MC"], ["MC", "BC"]],
    "Z": [["TL", "TR"], ["TR", "BL"], ["BL", "BR"]],
}
_LOOP = [8, "c(7)", "c(1)", "c(3)", "c(9)", 8]
#: Strokes of letters and digits by numpad waypoints; a point, v: a vertex, c: a curve, i: a crossing.
NUMPAD = {
    "A": {"pointed": [[1, "v(8)", 3], [4, 6]], "flat_top": [[1, 7, 9, 3], [4, 6]]},
    "B": {"default": [[7, 1], [7, "c(9)", "v(6)", "c(3)", 1]]},
    "C": {"default": [[9, "c(7)", "c(1)", 3]]},
    "D": {"default": [[7, 1], [7, "c(9)", "c(3)", 1]]},
    "E": {"default": [[9, 7, 1, 3], [4, 6]]},
    "F": {"default": [[9, 7, 1], [4, 6]]},
    "G": {"default": [[9, "c(7)", "c(1)", 3, 6], [6, 5]]},
    "H": {"default": [[7, 1], [9, 3], [4, 6]]},
    "I": {"default": [[8, 2]]},
    "J": {"default": [[8, "c(1)"]]},
    "K": {"default": [[7, 1], [9, "v(4)", 3]]},
    "L": {"default": [[7, 1, 3]]},
    "M": {"default": [[1, 7, "v(2)", 9, 3]]},
    "N": {"default": [[1, 7, 3, 9]]},
    "O": {"closed": [_LOOP]},
    "P": {"default": [[1, 7, "c(9)", "c(6)", 4]]},
    "Q": {"default": [_LOOP, [5, 3]]},
    "R": {"default": [[1, 7, "c(9)", "c(6)", 4], [4, 3]]},
    "S": {"default": [[9, "c(7)", "c(4)", "c(6)", "c(3)", 1]]},
    "T": {"default": [[7, 9], [8, 2]]},
    "U": {"default": [[7, "c(1)", "c(3)", 9]]},
    "V": {"default": [[7, "v(2)", 9]]},
    "W": {"default": [[7, "v(1)", "v(5)", "v(3)", 9]]},
    "X": {"default": [[7, 3], [9, 1]]},
    "Y": {"default": [[7, "v(5)", 9], [5, 2]]},
    "Z": {"default": [[7, 9, 1, 3]]},
    "a": {"default": [[9, "c(7)", "c(1)", 3], [9, 3]]},
    "b": {"default": [[7, 1, "c(3)", "c(9)", 4]]},
    "c": {"default": [[9, "c(7)", "c(1)", 3]]},
    "d": {"default": [[9, "c(7)", "c(1)", 3], [9, 3]]},
    "e": {"default": [[6, 4, "c(1)", "c(3)", "c(6)"]]},
    "f": {"default": [[9, "c(8)", 2], [4, 6]]},
    "g": {"default": [[9, "c(7)", "c(1)", "c(3)", 9], [9, "c(3)"]]},
    "h": {"default": [[7, 1], [4, "c(9)", 3]]},
    "i": {"default": [[8, 2]]},
    "j": {"default": [[8, "c(1)"]]},
    "k": {"default": [[7, 1], [9, "v(4)", 3]]},
    "l": {"default": [[8, 2]]},
    "m": {"default": [[1, 4, "c(8)", 5], [5, "c(9)", 3]]},
    "n": {"default": [[1, 4, "c(9)", 3]]},
    "o": {"closed": [_LOOP]},
    "p": {"default": [[4, "c(7)", "c(9)", "c(6)", 1]]},
    "q": {"default": [[9, "c(7)", "c(1)", "c(3)", 9], [9, 3]]},
    "r": {"default": [[1, 4, "c(9)"]]},
    "s": {"default": [[9, "c(7)", "c(4)", "c(6)", "c(3)", 1]]},
    "t": {"default": [[8, 2], [7, 9]]},
    "u": {"default": [[7, "c(1)", "c(3)", 9], [9, 3]]},
    "v": {"default": [[7, "v(2)", 9]]},
    "w": {"default": [[7, "v(1)", "v(5)", "v(3)", 9]]},
    "x": {"default": [[7, 3], [9, 1]]},
    "y": {"default": [[7, "v(5)"], [9, "v(5)", "c(1)"]]},
    "z": {"default": [[7, 9, 1, 3]]},
    "0": {"closed": [_LOOP], "open": [[8, "c(7)", "c(1)", "c(3)", "c(9)"]], "ccw_open": [[7, "c(4)", "c(1)", "c(2)", "c(3)", "c(6)", "c(9)", "c(8)", "c(7)", 4]]},
    "1": {"with_serif": [[7, 8, 2]], "simple": [[8, 2]], "with_base": [[4, "v(8)", 2], [1, 2, 3]]},
    "2": {"default": [[7, "v(4)", 1, 3]]},
    "3": {"default": [[7, "c(9)", "v(4)", "c(3)", 1]]},
    "4": {"open": [[7, "v(4)", 6], [9, 3]], "closed": [[7, "v(4)", 6, 9], [9, 3]]},
    "5": {"default": [[9, 7, 4, "c(6)", "c(3)", 1]], "two_stroke": [[9, 8, 7], [7, 4, 5, 6, 3, 2, 1]]},
    "6": {"default": [[9, "c(7)", "c(1)", "c(3)", "c(6)", 4]], "end_at_1": [[9, "c(7)", "c(1)", "c(3)", "c(6)", 1]]},
    "7": {"default": [[7, 9, 1]]},
    "8": {"default": [[8, "c(7)", "c(4)", "c(1)", "c(2)", "c(3)", "c(6)", "c(9)", 8]], "from_9": [[9, 8, 7, 4, "straight", "i(5)", "straight", 6, 3, 2, 1, "i(5)", 9]]},
    "9": {"default": [[6, "c(9)", "c(8)", "c(7)", "c(4)", 6], [6, "c(3)", 1]]},
}


class Templates:
    """Character -> variant -> strokes, each a list of waypoints ("7", "v(8)", "c(3)", hints)."""

    def __init__(self, numpad: bool = False):
        self.known: dict[str, dict[str, list[list[str]]]] = {}
        for char, strokes in () if numpad else CAPITALS.items():
            self.add(char, "regions", [[CELLS[r] for r in s] for s in strokes])
        for char, variants in NUMPAD.items() if numpad else ():
            for variant, strokes in variants.items():
                self.add(char, variant, strokes)

    def add(self, char: str, variant: str, strokes: Sequence[Sequence[str]]) -> Templates:
        self.known.setdefault(char, {})[variant] = [list(map(str, s)) for s in strokes]
        return self

    def variants(self, char: str) -> Mapping[str, list[list[str]]]:
        return self.known.get(char, {})

    def stroke_counts(self, char: str) -> list[int]:
        """How many strokes the variants of a character have."""
        return sorted({len(s) for s in self.variants(char).values()})

    def rows(self) -> Iterator[tuple[str, str, list[list[str]]]]:
        for char in sorted(self.known):
            for variant in sorted(self.known[char]):
                yield char, variant, self.known[char][variant]

    def frame(self, spark: SparkSession) -> DataFrame:
        """char, variant, strokes of all templates, for joins."""
        return spark.createDataFrame(list(self.rows()), "char string, variant string, strokes array<array<string>>")

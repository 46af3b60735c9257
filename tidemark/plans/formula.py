"""A small formula language for indicators, and its compiler to levels of SQL columns.

A formula is text such as ``(Close - mean(Close, 20)) / (std(Close, 20) + EPS)``. Names are columns or other formulas. Calls of frame functions
(rolling aggregates, lags, run lengths, ranks) become columns of their own, shared by all formulas that need them; macros are
rewritten into simpler calls. Every column has a level, one above the highest it reads, so that a level is one SELECT over the one below. The
text of a column is written for one of two dialects, Spark SQL or DuckDB SQL; recursions (``ema``, ``kama``, ``supertrend``), whole-series
ranks and what needs the order of a window's values (quantiles, ranks, entropy, rescaled range) have no Spark text and are run by a grouped kernel there.

NULL is the only missing value. A rolling aggregate over w rows is NULL unless all w values are there; a condition that can't
be decided is false. A bare division by zero gives NULL; ``safe`` divides by a denominator that EPS is added to, so it gives NULL only where that sum is zero.
"""

from __future__ import annotations

import ast
import math
from dataclasses import dataclass, field

EPS = 1e-9

#: Shorthands: parameters and body. They stand for what they say; the compiler only sees the bodies.
MACROS: dict[str, tuple[list[str], str]] = {
    "diff": (["x"], "x - lag(x, 1)"),
    "diffn": (["x", "k"], "x - lag(x, k)"),
    "pct": (["x", "k"], "x / lag(x, k) - 1"),
    "safe": (["a", "b"], "a / (b + EPS)"),
    "z": (["x", "w"], "(x - mean(x, w)) / (std(x, w) + EPS)"),
    "squash": (["x"], "tanh(coalesce(z(x, 60), 0))"),
    "clip": (["x", "a", "b"], "case(x < a, a, case(x > b, b, x))"),
    "atleast": (["x", "a"], "case(x < a, a, x)"),
    "atmost": (["x", "b"], "case(x > b, b, x)"),
    "cross_up": (["x", "y"], "flag(x > y and lag(x, 1) <= lag(y, 1))"),
    "cross_down": (["x", "y"], "flag(x < y and lag(x, 1) >= lag(y, 1))"),
    "rise_over": (["x", "c"], "flag(x > c and lag(x, 1) <= c)"),
    "fall_under": (["x", "c"], "flag(x < c and lag(x, 1) >= c)"),
    "turned": (["x"], "unlike(sign(x), sign(lag(x, 1)))"),
    "above_own": (["x", "q", "w"], "flag(x > quant(x, q, w))"),
    "below_own": (["x", "q", "w"], "flag(x < quant(x, q, w))"),
    "rsi": (["x", "w"], "100 - 100 / (1 + mean(atleast(diff(x), 0), w) / (-mean(atmost(diff(x), 0), w) + EPS))"),
    "macd": (["x"], "ema(x, 12) - ema(x, 26)"),
    "drawdown": (["x", "w"], "(x - high(x, w)) / (high(x, w) + EPS)"),
    "hl": ([], "High - Low"),
    "prev": (["x"], "lag(x, 1)"),
    "true_range": ([], "largest(High - Low, abs(High - prev(Close)), abs(Low - prev(Close)))"),
    "unit": (["x", "most"], "clip(x, 0, most) / most"),
}

#: Frame functions that recurse over a whole series.
RECURSIVE = ("ema", "kama", "supertrend_line", "supertrend_side")

#: Frame functions of the order of a series or a window: in SQL each would be a sort of its own, or a list of the window for each row.
ORDERED = ("rankpct", "quant", "pctrank", "entropy", "hurst", "argmax", "argmin")


@dataclass
class Column:
    """A column to be made: its SQL text by dialect (None: by the kernel), the columns it reads, and its level."""

    name: str
    text: dict[str, str] | None
    reads: set[str]
    level: int
    kernel: tuple | None = None


@dataclass
class Compiler:
    """Compiles formulas over ``base`` columns. ``key`` and ``order`` name the columns of series and time."""

    formulas: dict[str, str]
    base: set[str]
    key: str = "symbol"
    order: str = "dt"
    columns: dict[str, Column] = field(default_factory=dict)
    _shared: dict[str, str] = field(default_factory=dict)
    _busy: set[str] = field(default_factory=set)
    _count: int = 0

    # -- columns -------------------------------------------------------------------------------------------------------------

    def need(self, name: str) -> str:
        """Makes sure that the named column exists."""
        if name in self.base or name in self.columns:
            return name
        if name not in self.formulas:
            raise KeyError(f"no column or formula {name!r}")
        if name in self._busy:
            raise ValueError(f"formula {name!r} needs itself")
        self._busy.add(name)
        tree = self._expand(ast.parse(self.formulas[name], mode="eval").body)
        self._add(name, tree)
        self._busy.discard(name)
        return name

    def _fresh(self, prefix: str) -> str:
        self._count += 1
        return f"{prefix}{self._count}"

    def _add(self, name: str, tree: ast.expr) -> None:
        if isinstance(tree, ast.Call) and tree.func.id in FRAMES:
            self._frame(tree, name)
            return
        reads: set[str] = set()
        text = {d: self._text(tree, d, reads) for d in ("spark", "duckdb")}
        self.columns[name] = Column(name, text, reads, self._above(reads))

    def _above(self, reads: set[str]) -> int:
        return 1 + max((self.columns[r].level for r in reads if r in self.columns), default=0)

    def _frame(self, call: ast.Call, name: str | None = None) -> str:
        """The column of a frame function's call."""
        same = ast.unparse(call)
        if same in self._shared and name is None:
            return self._shared[same]
        name = name or self._fresh("_w")
        kind = call.func.id
        reads: set[str] = set()
        if kind in RECURSIVE + ORDERED:
            inputs, numbers = [], []
            for arg in call.args:
                value = _number(arg)
                if value is not None:
                    numbers.append(value)
                elif isinstance(arg, ast.Name):
                    inputs.append(self.need(arg.id))
                else:
                    inputs.append(self._frame(arg) if isinstance(arg, ast.Call) and arg.func.id in FRAMES else self._scalar(arg))
            reads |= set(inputs)
            text = {"spark": None, "duckdb": FRAMES[kind](self, "duckdb", *map(_quoted, inputs), *numbers)}
            self.columns[name] = Column(name, text, reads, self._above(reads), (kind, tuple(inputs), tuple(numbers)))
        else:
            text = {}
            for d in ("spark", "duckdb"):
                args = [v if (v := _number(a)) is not None else self._text(a, d, reads) for a in call.args]
                text[d] = FRAMES[kind](self, d, *args)
            if kind in ("run", "slope", "r2", "nw"):
                reads.add("rn")
            self.columns[name] = Column(name, text, reads, self._above(reads))
        self._shared.setdefault(same, name)
        return name

    def _scalar(self, tree: ast.expr) -> str:
        """A column for a plain expression that a kernel reads."""
        same = ast.unparse(tree)
        if same not in self._shared:
            name = self._fresh("_s")
            self._shared[same] = name
            self._add(name, tree)
        return self._shared[same]

    # -- text ----------------------------------------------------------------------------------------------------------------

    def _expand(self, tree: ast.expr, given: dict[str, ast.expr] | None = None) -> ast.expr:
        """Rewrites macros, with their parameters replaced."""
        given = given or {}
        if isinstance(tree, ast.Name):
            return given.get(tree.id, tree)
        if isinstance(tree, ast.Call):
            args = [self._expand(a, given) for a in tree.args]
            if tree.func.id in MACROS:
                names, body = MACROS[tree.func.id]
                return self._expand(ast.parse(body, mode="eval").body, dict(zip(names, args, strict=True)))
            return ast.Call(tree.func, args, [])
        out = type(tree)(**{f: getattr(tree, f) for f in tree._fields})
        for f in tree._fields:
            value = getattr(tree, f)
            if isinstance(value, ast.expr):
                setattr(out, f, self._expand(value, given))
            elif isinstance(value, list) and value and isinstance(value[0], ast.expr):
                setattr(out, f, [self._expand(v, given) for v in value])
        return out

    def _text(self, tree: ast.expr, d: str, reads: set[str]) -> str:
        def go(x: ast.expr) -> str:
            return self._text(x, d, reads)

        value = _number(tree)
        if value is not None:
            return _literal(value)
        match tree:
            case ast.Name(id="EPS"):
                return _literal(EPS)
            case ast.Name(id=name):
                reads.add(self.need(name))
                return _quoted(name)
            case ast.BinOp(left=a, op=op, right=b):
                left, right = go(a), go(b)
                match op:
                    case ast.Div():
                        return f"({left} / nullif({right}, 0e0))"
                    case ast.Pow():
                        return f"power({left}, {right})"
                sign = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*"}[type(op)]
                return f"({left} {sign} {right})"
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return f"(-{go(x)})"
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return f"(NOT {go(x)})"
            case ast.BoolOp(op=op, values=values):
                return "(" + (" AND " if isinstance(op, ast.And) else " OR ").join(map(go, values)) + ")"
            case ast.Compare(left=a, ops=ops, comparators=others):
                parts, left = [], go(a)
                for op, other in zip(ops, others, strict=True):
                    right = go(other)
                    sign = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "<>"}[type(op)]
                    parts.append(f"{left} {sign} {right}")
                    left = right
                return "(" + " AND ".join(parts) + ")"
            case ast.Call(func=ast.Name(id=kind), args=args):
                if kind in FRAMES:
                    name = self._frame(tree)
                    reads.add(name)
                    return _quoted(name)
                return SCALARS[kind](*map(go, args))
        raise ValueError(f"can't read {ast.unparse(tree)}")

    # -- windows -------------------------------------------------------------------------------------------------------------

    def over(self, rows: int | None = None, behind: int = 0, ahead: int = 0) -> str:
        """The series' window: ``rows`` rows up to this one, or from its start (0), or the whole order (None)."""
        text = f"PARTITION BY {_quoted(self.key)} ORDER BY {_quoted(self.order)}"
        if rows is not None:
            start = "UNBOUNDED PRECEDING" if rows == 0 else f"{int(rows) - 1} PRECEDING"
            text += f" ROWS BETWEEN {start} AND CURRENT ROW"
        return f"OVER ({text})"

    def levels(self, names: list[str]) -> list[list[Column]]:
        """Columns that ``names`` need, by level. Ancestors of recursions come first, so that kernels see narrow rows."""
        wanted: dict[str, Column] = {}

        def visit(name: str) -> None:
            if name in self.columns and name not in wanted:
                wanted[name] = self.columns[name]
                for r in self.columns[name].reads:
                    visit(r)

        for n in names:
            visit(self.need(n))
        early: set[str] = set()

        def ancestors(name: str) -> None:
            if name in wanted and name not in early:
                early.add(name)
                for r in wanted[name].reads:
                    ancestors(r)

        for c in list(wanted.values()):
            if c.kernel and c.kernel[0] in RECURSIVE:
                ancestors(c.name)
        out: list[list[Column]] = []
        done = {n for n in self.base}
        for group in ([c for c in wanted.values() if c.name in early], [c for c in wanted.values() if c.name not in early]):
            rest = list(group)
            while rest:
                ready = [c for c in rest if c.reads <= done]
                if not ready:
                    raise ValueError(f"no order for {[c.name for c in rest][:5]}")
                # recursions wait for all plain columns that are ready
                plain = [c for c in ready if not c.kernel] or ready
                out.append(plain)
                done |= {c.name for c in plain}
                rest = [c for c in rest if c.name not in done]
        return out


def _number(tree: ast.expr) -> float | int | None:
    if isinstance(tree, ast.Constant) and isinstance(tree.value, (int, float)):
        return tree.value
    if isinstance(tree, ast.UnaryOp) and isinstance(tree.op, ast.USub) and isinstance(tree.operand, ast.Constant):
        return -tree.operand.value
    return None


def _literal(value: float) -> str:
    text = repr(float(value))
    return text if "e" in text else f"{text}e0"


def _quoted(name: str) -> str:
    """A bare word in either dialect; other names are given as words by the base table."""
    return name


def _mean_of(*xs: str) -> str:
    """The mean of those that aren't NULL."""
    total = " + ".join(f"coalesce({x}, 0e0)" for x in xs)
    count = " + ".join(f"(CASE WHEN {x} IS NULL THEN 0e0 ELSE 1e0 END)" for x in xs)
    return f"(({total}) / nullif({count}, 0e0))"


def _spread_of(*xs: str) -> str:
    """The sample standard deviation of values, none of them NULL."""
    n = len(xs)
    mean = f"(({' + '.join(xs)}) / {n}e0)"
    return f"sqrt(({' + '.join(f'power({x} - {mean}, 2e0)' for x in xs)}) / {n - 1}e0)"


SCALARS = {
    "abs": lambda x: f"abs({x})",
    "sign": lambda x: f"CAST(sign({x}) AS DOUBLE)",
    "sqrt": lambda x: f"sqrt(CASE WHEN {x} >= 0e0 THEN {x} END)",
    "ln": lambda x: f"ln(CASE WHEN {x} > 0e0 THEN {x} END)",
    "exp": lambda x: f"exp({x})",
    "tanh": lambda x: f"tanh({x})",
    "floor": lambda x: f"CAST(floor({x}) AS DOUBLE)",
    "coalesce": lambda *x: f"coalesce({', '.join(x)})",
    "largest": lambda *x: f"greatest({', '.join(x)})",
    "smallest": lambda *x: f"least({', '.join(x)})",
    "case": lambda c, a, b: f"(CASE WHEN {c} THEN {a} ELSE {b} END)",
    "when": lambda c, a: f"(CASE WHEN {c} THEN {a} END)",
    "flag": lambda c: f"(CASE WHEN {c} THEN 1e0 ELSE 0e0 END)",
    "unlike": lambda a, b: f"(CASE WHEN {a} = {b} THEN 0e0 ELSE 1e0 END)",
    "avg_of": _mean_of,
    "spread_of": _spread_of,
    "snap": lambda x: f"round({x}, 12)",
    "nonzero": lambda x: f"nullif({x}, 0e0)",
}


# -- frame functions: (compiler, dialect, arguments) to text ---------------------------------------------------------------------


def _gated(c: Compiler, d: str, x: str, w: int, value: str) -> str:
    """``value`` where all of a window's values are known. Spark goes through a sliding frame anew for each row, so there the rows since the last gap are taken, from a frame that only grows."""
    if d == "spark":
        return f"(CASE WHEN rn - coalesce(max(CASE WHEN ({x}) IS NULL THEN rn END) {c.over(0)}, 0) >= {int(w)} THEN {value} END)"
    return f"(CASE WHEN count({x}) {c.over(w)} = {int(w)} THEN {value} END)"


def _plain(function: str):
    return lambda c, d, x, w: _gated(c, d, x, w, f"{function}({x}) {c.over(w)}")


def _quant(c, d, x, q, w):
    return _gated(c, d, x, w, f"quantile_cont({x}, {q}) {c.over(w)}")


def _skew(c, d, x, w):
    if d == "duckdb":
        return _gated(c, d, x, w, f"skewness({x}) {c.over(w)}")
    return _gated(c, d, x, w, f"skewness({x}) {c.over(w)} * {_literal(math.sqrt(w * (w - 1)) / (w - 2))}")


def _kurt(c, d, x, w):
    if d == "duckdb":
        return _gated(c, d, x, w, f"kurtosis({x}) {c.over(w)}")
    a, b = (w - 1) / ((w - 2) * (w - 3)), w + 1
    return _gated(c, d, x, w, f"({_literal(b)} * kurtosis({x}) {c.over(w)} + 6e0) * {_literal(a)}")


def _both(x: str, y: str) -> str:
    return f"CASE WHEN {y} IS NOT NULL THEN {x} END"


def _cov(c, d, x, y, w):
    return _gated(c, d, _both(x, y), w, f"covar_samp({x}, {y}) {c.over(w)}")


def _corr(c, d, x, y, w):
    spread = f"(stddev_samp({_both(x, y)}) {c.over(w)} * stddev_samp({_both(y, x)}) {c.over(w)})"
    value = f"covar_samp({x}, {y}) {c.over(w)} / nullif({spread}, 0e0)"
    return _gated(c, d, _both(x, y), w, value)


def _lag(c, d, x, k):
    return f"lag({x}, {int(k)}) {c.over()}"


def _lead(c, d, x, k):
    return f"lead({x}, {int(k)}) {c.over()}"


def _run(c, d, cond):
    return f"CAST(rn - coalesce(max(CASE WHEN {cond} THEN NULL ELSE rn END) {c.over(0)}, 0) AS DOUBLE)"


def _rankpct(c, d, x):
    part = f"PARTITION BY {c.key}"
    rank = f"rank() OVER ({part} ORDER BY {x} ASC NULLS LAST)"
    ties, every = f"count(*) OVER ({part}, {x})", f"count({x}) OVER ({part})"
    return f"(CASE WHEN {x} IS NOT NULL THEN ({rank} + ({ties} - 1) / 2e0) / {every} END)"


def _list(c, d, x, w):
    return f"list({x}) {c.over(w)}"


def _filtered(values: str, test: str) -> str:
    return f"len(list_filter({values}, lambda v: {test}))"


def _pctrank(c, d, x, w):
    values = _list(c, d, x, w)
    return _gated(c, d, x, w, f"({_filtered(values, f'v < {x}')} + ({_filtered(values, f'v = {x}')} + 1) / 2e0) / {_literal(w)}")


def _autocorr(c, d, x, k, w):
    return _corr(c, d, x, f"_lagged_{int(k)}({x})", w)


def _slope(c, d, x, w):
    return _gated(c, d, x, w, f"regr_slope({x}, CAST(rn AS DOUBLE)) {c.over(w)}")


def _r2(c, d, x, w):
    squares = f"(var_pop({x}) {c.over(w)} * {_literal(w)})"
    fit = f"(power(covar_pop({x}, CAST(rn AS DOUBLE)) {c.over(w)}, 2e0) / {_literal((w * w - 1) / 12)} * {_literal(w)})"
    return _gated(c, d, x, w, f"1e0 - ({squares} - {fit}) / ({squares} + {_literal(EPS)})")


def _fir(c: Compiler, x: str, weights: list[float]) -> str:
    return "(" + " + ".join(f"{_literal(v)} * {_lag(c, '', x, k) if k else x}" for k, v in enumerate(weights)) + ")"


def _curve(c, d, x, w):
    """Twice the leading coefficient of the least-squares parabola over equally spaced points: a fixed weight for each."""
    t = [w - 1 - k - (w - 1) / 2 for k in range(int(w))]
    q = [v * v - (w * w - 1) / 12 for v in t]
    norm = sum(v * v for v in q)
    return _gated(c, d, x, w, _fir(c, x, [2 * v / norm for v in q]))


def _wma(c, d, x, w):
    return _gated(c, d, x, w, _fir(c, x, [2 * (w - k) / (w * (w + 1)) for k in range(int(w))]))


def _nw(c, d, x, h, w):
    """Gaussian weights over this row and the w before it, as far as there are any."""
    weights = [math.exp(-0.5 * (k / h) ** 2) for k in range(int(w) + 1)]
    total = " + ".join(f"{_literal(v)} * coalesce({_lag(c, d, x, k) if k else x}, 0e0)" for k, v in enumerate(weights))
    norm = " + ".join(f"(CASE WHEN rn > {k} THEN {_literal(v)} ELSE 0e0 END)" for k, v in enumerate(weights))
    return f"(({total}) / ({norm} + {_literal(EPS)}))"


def _entropy(c, d, x, w, bins):
    values = _list(c, d, x, w)
    low, wide = f"min({x}) {c.over(w)}", f"(max({x}) {c.over(w)} - min({x}) {c.over(w)})"
    part = f"least(floor((v - {low}) / nullif({wide}, 0e0) * {bins}), {bins - 1})"
    share = f"{_filtered(values, f'{part} = b')} / {_literal(w + EPS)}"
    value = f"list_sum(list_transform(list_transform(range({bins}), lambda b: {share}), lambda p: CASE WHEN p > 0e0 THEN -p * ln(p + {_literal(EPS)}) ELSE 0e0 END))"
    alone = _literal(-(w / (w + EPS)) * math.log(w / (w + EPS) + EPS))
    return _gated(c, d, x, w, f"CASE WHEN {wide} = 0e0 THEN {alone} ELSE {value} END")


def _hurst(c, d, x, w):
    values, mean = _list(c, d, x, w), f"avg({x}) {c.over(w)}"
    sums = f"list_transform(range(1, {int(w) + 1}), lambda k: list_sum(({values})[1:k]) - k * ({mean}))"
    reach = f"(list_max({sums}) - list_min({sums}))"
    spread = f"(stddev_pop({x}) {c.over(w)} + {_literal(EPS)})"
    return _gated(c, d, x, w, f"ln(({reach}) / {spread} + {_literal(EPS)}) / {_literal(math.log(w + EPS))}")


def _firstmax(order: str):
    def make(c, d, x, w):
        values = _list(c, d, x, w)
        return _gated(c, d, x, w, f"CAST(list_position({values}, list_{order}({values})) - 1 AS DOUBLE)")

    return make


def _ema(c, d, x, span):
    a = 2 / (span + 1)
    values = f"list({x}) FILTER (WHERE {x} IS NOT NULL) {c.over(0)}"
    return f"list_reduce({values}, lambda p, q: p * {_literal(1 - a)} + q * {_literal(a)})"


def _kama(c, d, x, smooth):
    values = f"list(struct_pack(c := {x}, s := coalesce({smooth}, 0e0))) {c.over(0)}"
    return f"list_reduce({values}, lambda p, q: struct_pack(c := p.c + q.s * (q.c - p.c), s := 0e0)).c"


def _supertrend(part: str):
    def make(c, d, high, low, close, atr, multiple):
        rows = f"list(struct_pack(h := {high}, l := {low}, c := {close}, a := {atr}, u := CAST(NULL AS DOUBLE), d := CAST(NULL AS DOUBLE), w := 1e0)) {c.over(0)}"
        up, down = (f"((q.h + q.l) / 2e0 {sign} {_literal(multiple)} * q.a)" for sign in "+-")
        fields = {
            "h": "q.h", "l": "q.l", "c": "q.c", "a": "q.a",
            "u": f"CASE WHEN q.a IS NULL THEN p.u WHEN p.u IS NULL OR {up} < p.u OR p.c > p.u THEN {up} ELSE p.u END",
            "d": f"CASE WHEN q.a IS NULL THEN p.d WHEN p.d IS NULL OR {down} > p.d OR p.c < p.d THEN {down} ELSE p.d END",
            "w": "CASE WHEN q.a IS NULL OR p.u IS NULL THEN p.w WHEN q.c > p.u THEN 1e0 WHEN q.c < p.d THEN -1e0 ELSE p.w END",
        }
        last = f"list_reduce({rows}, lambda p, q: struct_pack({', '.join(f'{k} := {v}' for k, v in fields.items())}))"
        if part == "side":
            return f"(CASE WHEN {atr} IS NULL THEN 1e0 ELSE {last}.w END)"
        return f"(CASE WHEN {atr} IS NOT NULL THEN CASE WHEN {last}.w > 0e0 THEN {last}.d ELSE {last}.u END END)"

    return make


FRAMES = {
    "mean": _plain("avg"), "total": _plain("sum"), "high": _plain("max"), "low": _plain("min"), "std": _plain("stddev_samp"), "var": _plain("var_samp"), "quant": _quant, "skew": _skew, "kurt": _kurt, "cov": _cov, "corr": _corr,
    "lag": _lag, "lead": _lead, "run": _run, "runsum": lambda c, d, x: f"sum({x}) {c.over(0)}", "runmax": lambda c, d, x: f"max({x}) {c.over(0)}", "rankpct": _rankpct, "pctrank": _pctrank, "slope": _slope, "r2": _r2, "curve": _curve, "wma": _wma,
    "nw": _nw, "entropy": _entropy, "hurst": _hurst, "argmax": _firstmax("max"), "argmin": _firstmax("min"), "ema": _ema, "kama": _kama, "supertrend_line": _supertrend("line"), "supertrend_side": _supertrend("side"),
    "fill": lambda c, d, x: f"last_value({x} IGNORE NULLS) {c.over(0)}" if d == "duckdb" else f"last({x}, true) {c.over(0)}", "periods": lambda c, d: f"CAST(count(*) OVER (PARTITION BY {c.key}) AS DOUBLE)",
}
MACROS["med"] = (["x", "w"], "quant(x, 0.5, w)")
MACROS["autocorr"] = (["x", "k", "w"], "corr(x, lag(x, k), w - k)")

"""Rewrite rules for generated code: tables of rules, applied one after the other by one native expression.

Each rule is a step on a value that the step before binds, so the text is read from its column once however many rules
there are, and the expression grows with the rules alone. A rule's pattern is a literal of its step, so a task compiles
it once. A rule names a literal that every match contains: a byte search for it comes first, and only texts that hold it
pay for the regex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules that look at one line at a time: (all of these in the line, none of these in the line,
# pattern, replacement, note). Fixed values, in order.
LINE_RULES = (
    (("NumberLine(", "x_length="), (), "x_length=", "length=", "replace NumberLine x_length with length"),
    (("Axes(", "z_range="), (), "^(.*?)(?<!ThreeD)Axes\\(", "$1ThreeDAxes(", "upgrade 3d Axes to ThreeDAxes"),
    ((".add_caption(",), (), "(?s)^\\s*\\w+\\.add_caption\\(.*$", "", "remove unsupported add_caption calls"),
    ((".add_labels()",), (), "\\.add_labels\\(\\)", ".add_numbers()", "replace bare add_labels() with add_numbers()"),
    (("run_time=",), ("self.play(",), ",\\s*run_time\\s*=\\s*[^),]+", "", "strip non-play run_time kwargs"),
    (("self.play(", ".become("), (), "(\\b\\w+)\\.become\\(", "$1.animate.become(", "animate become calls inside self.play"),
    (
        ("self.play(", ".set_points_smoothly("), (),
        "(\\b\\w+)\\.set_points_smoothly\\(", "$1.animate.set_points_smoothly(",
        "animate set_points_smoothly calls inside self.play",
    ),
)

# Rules over the whole text: (literal, pattern, replacement, note). Fixed values, in order. The
# receiver of get_origin() is replaced together with the call.
TEXT_RULES = (
    ("ORANGE_", "\\bORANGE_[A-E]\\b", "ORANGE", "replace unsupported ORANGE shade aliases"),
    (".move_by(", "\\.move_by\\(", ".shift(", "replace unsupported move_by with shift"),
    ("Pipe(", "\\bPipe\\(", "Line(", "replace unsupported Pipe with Line"),
    ("GraphLayout(", "layout\\s*=\\s*GraphLayout\\(([^)]+)\\)", "layout=$1", "replace GraphLayout wrapper with layout string"),
    (".plot_polar(", "\\.plot_polar\\(", ".plot_polar_graph(", "replace plot_polar with plot_polar_graph"),
    (".get_axis_range()", "\\.get_axis_range\\(\\)", ".x_range", "replace get_axis_range() with x_range"),
    (".get_origin()", "(?:\\b\\w++(?:\\.\\w+|\\([^()]*\\)|\\[[^\\[\\]]*\\])*?)?\\.get_origin\\(\\)", "ORIGIN", "replace get_origin() with ORIGIN"),
    (".axis_range", "\\.axis_range\\b", ".x_range", "replace axis_range with x_range"),
    ("VectorField(", "\\bVectorField\\(", "ArrowVectorField(", "replace VectorField with ArrowVectorField"),
    ("ImageTexture(", ",\\s*texture\\s*=\\s*ImageTexture\\([^)]*\\)", "", "remove unsupported ImageTexture usage"),
    ("**{", ",\\s*\\*\\*\\{['\"]radius['\"]:\\s*[^}]+\\}", "", "remove misplaced VGroup radius kwargs"),
    (
        "MoveToTarget(",
        "MoveToTarget\\(\\s*([A-Za-z_]\\w*)\\s*,\\s*target=([^,\\n)]+)(?:,\\s*[^)]*)?\\)", "$1.animate.move_to($2)",
        "replace unsupported MoveToTarget(target=...) usage",
    ),
    (
        "SurroundingRectangle(",
        "SurroundingRectangle\\((axes\\.c2p\\([^)]+\\)),\\s*([0-9.]+),\\s*([0-9.]+),\\s*color=([^,]+),\\s*fill_opacity=([0-9.]+)\\)",
        "Rectangle(width=$2, height=$3, color=$4, fill_opacity=$5).move_to($1)",
        "replace SurroundingRectangle point usage with Rectangle.move_to",
    ),
    ("caption_text", "\\bcaption_text\\b", "phase_caption", "replace undefined caption_text reference with phase_caption"),
    (
        "[", "\\[\\s*(['\"][^'\"]+['\"])\\s*,\\s*(['\"][^'\"]+['\"])\\s*\\]", "($1, $2)", "replace string pair lists with tuples",
    ),
)

# Rules that need a matching render log: (log pattern, text rules). Fixed values.
REPAIR_RULES = (
    (
        "(?i)Unexpected argument .* passed to Scene\\.play\\(\\)",
        (
            (".become(", "(\\b\\w+)\\.become\\(", "$1.animate.become(", "animate become calls after Scene.play failure"),
            (
                ".set_points_smoothly(", "(\\b\\w+)\\.set_points_smoothly\\(", "$1.animate.set_points_smoothly(",
                "animate set_points_smoothly calls after Scene.play failure",
            ),
        ),
    ),
)

# Where one line ends and the next begins, as Python counts lines (fixed values).
LINE_END = "(?<=[\\n\\x0B\\x0C\\x1C-\\x1E\\x85\\x{2028}\\x{2029}]|\\r(?!\\n))"


def _unicode(pattern: str) -> str:
    return "(?U)" + pattern


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _after_line_rules(code: Column) -> Column:
    """``struct(lines, found)``: the lines, and where each rule that fired did so first."""
    def step(number: int, rule: tuple):
        needed, barred, pattern, replacement, note = rule

        def one(line: Column) -> Column:
            applies = F.lit(True)
            for literal in needed:
                applies = applies & F.contains(line, F.lit(literal))
            for literal in barred:
                applies = applies & ~F.contains(line, F.lit(literal))
            return F.when(applies, F.regexp_replace(line, _unicode(pattern), replacement)).otherwise(line)

        def judged(so_far: Column):
            def with_first(lines: Column) -> Column:
                first = F.array_position(F.zip_with(so_far["lines"], lines, lambda a, b: a != b), F.lit(True))
                entry = F.struct(first.alias("line"), F.lit(number).alias("rule"), F.lit(note).alias("note"))
                found = F.when(first > 0, F.array_append(so_far["found"], entry)).otherwise(so_far["found"])
                return F.struct(lines.alias("lines"), found.alias("found"))

            return with_first

        return lambda so_far: _bound(F.transform(so_far["lines"], one), judged(so_far))

    none = F.array().cast("array<struct<line:bigint,rule:int,note:string>>")
    state = F.struct(F.split(code, LINE_END, -1).alias("lines"), none.alias("found"))
    for number, rule in enumerate(LINE_RULES):
        state = _bound(state, step(number, rule))
    return state


def _after_text_rules(text: Column, notes: Column, rules) -> Column:
    """``struct(text, notes)``: the text, and ``notes`` with the note of each rule that matched."""
    def step(literal: str, pattern: str, replacement: str, note: str):
        def judged(so_far: Column) -> Column:
            current, regex = so_far["text"], _unicode(pattern)
            possible = F.contains(current, F.lit(literal))
            return F.struct(
                F.when(possible, F.regexp_replace(current, regex, replacement)).otherwise(current).alias("text"),
                F.when(possible & F.rlike(current, F.lit(regex)), F.array_append(so_far["notes"], F.lit(note))).otherwise(so_far["notes"]).alias("notes"),
            )

        return judged

    state = F.struct(text.alias("text"), notes.alias("notes"))
    for rule in rules:
        state = _bound(state, step(*rule))
    return state


def normalised(code: Column) -> Column:
    """``struct(text, notes)`` of generated code; a null code stays null.

    Only a text with some line rule's literal is cut into lines. Line rules come first and are noted by
    the line each first fired on, then rule order; text rules follow in rule order.
    """
    none = F.array().cast("array<string>")

    def whole(c: Column) -> Column:
        cut = F.exists(_strings([needed[-1] for needed, *_ in LINE_RULES]), lambda n: F.contains(c, n))
        joined = lambda s: F.struct(
            F.array_join(s["lines"], "").alias("text"), F.transform(F.array_sort(s["found"]), lambda f: f["note"]).alias("notes")
        )
        lined = F.when(cut, _bound(_after_line_rules(c), joined)).otherwise(F.struct(c.alias("text"), none.alias("notes")))
        return _bound(lined, lambda s: _after_text_rules(s["text"], s["notes"], TEXT_RULES))

    return _bound(code, whole)


def normalise_code(df: DataFrame, code: str, out: str = "normal_code", notes: str = "notes") -> DataFrame:
    """Add ``out``, the rewritten code, and ``notes``, the rules that fired."""
    kept = [c for c in df.columns if c not in (out, notes)]
    return df.withColumn("_normal", normalised(F.col(code))).select(
        *kept, F.col("_normal.text").alias(out), F.array_distinct("_normal.notes").alias(notes)
    )


def _repair_step(called: Column, rules):
    """What one trigger makes of ``struct(text, notes)``: notes count only where the text changes."""
    none = F.array().cast("array<string>")

    def step(before: Column) -> Column:
        def judged(after: Column) -> Column:
            notes = F.when(after["text"] != before["text"], F.array_union(before["notes"], after["notes"])).otherwise(before["notes"])
            return F.struct(after["text"].alias("text"), notes.alias("notes"))

        return F.when(called, _bound(_after_text_rules(before["text"], none, rules), judged)).otherwise(before)

    return step


def repaired(code: Column, log: Column) -> Column:
    """``struct(text, notes)`` after the rules whose trigger the render log matches."""
    state = F.struct(code.alias("text"), F.array().cast("array<string>").alias("notes"))
    for trigger, rules in REPAIR_RULES:
        state = _bound(state, _repair_step(F.coalesce(F.rlike(log, F.lit(trigger)), F.lit(False)), rules))
    return state


def repair_code(df: DataFrame, code: str, log: str, out: str = "repaired_code", notes: str = "repair_notes") -> DataFrame:
    """Add ``out``, the code after the rules its render log calls for, and the rules that fired."""
    kept = [c for c in df.columns if c not in (out, notes)]
    return df.withColumn("_repaired", repaired(F.col(code), F.col(log))).select(
        *kept, F.col("_repaired.text").alias(out), F.col("_repaired.notes").alias(notes)
    )

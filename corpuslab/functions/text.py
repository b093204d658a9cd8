"""Text normal forms, ids, prompts and code-fence extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (fixed values).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Those of them that separate words on a line, as the trim of SQL takes them: no tabs and no line ends.
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
WHITESPACE_RUN = (
    "[\\t\\n\\x0B\\x0C\\r\\x1C-\\x1F \\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
)

CODE_FENCE = "```"
FENCE_LANGUAGE = "^(?i:python)"

# Phrase for a source domain where it differs from the domain's own name (fixed values).
DOMAIN_PHRASES = {"ml": "machine learning", "chemistry": "chemistry"}

# Fixed wording of a composed system prompt.
SKILL_HEADER = (
    "Apply the following repository skill as supplemental guidance. "
    "It does not change the output contract: return a single runnable Manim Python snippet "
    "that satisfies the user request."
)
PROMPT_SEPARATOR = "\n\n---\n\n"

# Fixed wording of the hardening suffix.
HARDENING_SENTINEL = "Prefer only built-in, documented Manim Community Edition APIs."
HARDENING_SUFFIX = (
    f" {HARDENING_SENTINEL} "
    "Do not reference external image, svg, or texture assets. "
    "Do not invent helper methods, classes, or attributes. "
    "Use only simple built-in primitives such as Scene, ThreeDScene, Axes, ThreeDAxes, "
    "NumberLine, NumberPlane, Circle, Dot, Line, Arrow, Graph, Text, MathTex, VGroup, "
    "Rectangle, RoundedRectangle, SurroundingRectangle, ValueTracker, ArrowVectorField, and Surface. "
    "Put run_time only on self.play calls, not on constructors or plot methods. "
    "Use layout='circular' style strings for Graph layouts. "
    "Use PolarPlane.plot_polar_graph for polar plots. "
    "Use only color constants that exist in manim; ORANGE has no A/B/C/D/E variants in this environment. "
    "If you need a panel, build it from Rectangle or RoundedRectangle and move a Text onto it instead of calling custom methods."
)


def strip(c: Column) -> Column:
    """Trim all Unicode whitespace, not only spaces; linear in the text."""
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Null where the text is null or nothing but whitespace; the text itself otherwise."""
    return F.when(strip(c) != "", c)


def first_truthy(*columns: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def normal_form(c: Column) -> Column:
    """Strip, lower and collapse whitespace: the key two prompts share when they say the same."""
    return F.regexp_replace(F.lower(strip(c)), WHITESPACE_RUN, " ")


def _dashed(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def slug(c: Column, default: str = "run") -> Column:
    return F.coalesce(F.nullif(_dashed(c), F.lit("")), F.lit(default))


def source_case_id(repo: Column, path: Column, scene: Column) -> Column:
    return _dashed(F.concat_ws("-", repo, path, scene))


def spaced_title(name: Column) -> Column:
    """``FadeInText`` → ``Fade In Text``."""
    return strip(F.regexp_replace(name, "(?<!^)(?=[A-Z])", " "))


def domain_phrase(domain: Column) -> Column:
    phrase = domain
    for key, text in DOMAIN_PHRASES.items():
        phrase = F.when(domain == key, F.lit(text)).otherwise(phrase)
    return phrase


def derived_prompt(scene: Column, domain: Column, repo: Column) -> Column:
    """Fixed prompt wording for a scene taken from a source repository."""
    return F.concat(
        F.lit("Create a Manim scene for a "), domain_phrase(domain),
        F.lit(" concept inspired by the `"), spaced_title(scene),
        F.lit("` example from the `"), repo,
        F.lit("` repository. Return runnable Python code with one main scene class."),
    )


def extract_code(c: Column) -> Column:
    """Body of the first closed code fence, or the whole text when there is none; stripped either way.

    Fences are found by position, so a long text without one costs a byte search and no regex.
    """
    fence = F.lit(CODE_FENCE)
    first = F.position(fence, c)
    second = F.position(fence, c, first + 3)
    body = F.substring(c, first + 3, second - first - 3)
    return strip(F.when((first > 0) & (second > 0), F.regexp_replace(body, FENCE_LANGUAGE, "")).otherwise(c))


def compose_system_prompt(base: Column, skill: Column) -> Column:
    """Base prompt and skill guidance, whichever are not blank; null when both are."""
    parts = F.concat_ws(
        PROMPT_SEPARATOR,
        F.nullif(strip(base), F.lit("")),
        F.concat(F.lit(SKILL_HEADER + "\n\n"), F.nullif(strip(skill), F.lit(""))),
    )
    return F.nullif(parts, F.lit(""))


def harden_prompt(c: Column) -> Column:
    """Append the hardening suffix once; null stays null."""
    return F.when(F.contains(c, F.lit(HARDENING_SENTINEL)), c).otherwise(
        F.concat(rstrip(c), F.lit(HARDENING_SUFFIX))
    )


def log_tail(c: Column, size: int = 1500) -> Column:
    """The last ``size`` characters of a log."""
    return F.right(c, F.lit(size))


def _variant_is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def message_text(content_json: Column) -> Column:
    """Text of a chat message whose content is a JSON string or a list of text parts.

    Null where the content is neither, so the caller can route such rows to its violations.
    """
    v = F.try_parse_json(content_json)
    kind = F.schema_of_variant(v)

    def part_text(part: Column) -> Column:
        plain = F.when(_variant_is_string(part), F.try_variant_get(part, "$", "string"))
        tagged = F.when(
            (F.try_variant_get(part, "$.type", "string") == "text")
            & _variant_is_string(F.try_variant_get(part, "$.text", "variant")),
            F.try_variant_get(part, "$.text", "string"),
        )
        nested = F.when(
            _variant_is_string(F.try_variant_get(part, "$.text.value", "variant")),
            F.try_variant_get(part, "$.text.value", "string"),
        )
        return strip(F.coalesce(plain, tagged, nested))

    parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), part_text)
    joined = strip(F.array_join(F.filter(parts, lambda p: p != ""), "\n"))
    return F.when(kind == "STRING", strip(F.try_variant_get(v, "$", "string"))).when(
        F.startswith(kind, F.lit("ARRAY")), joined
    )

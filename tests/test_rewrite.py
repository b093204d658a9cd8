from __future__ import annotations

from corpuslab.functions import rewrite


def normalised(spark, *codes):
    rows = spark.createDataFrame(list(enumerate(codes)), "id long, code string")
    return {r["id"]: (r["normal_code"], r["notes"]) for r in rewrite.normalise_code(rows, "code").collect()}


FIRST = """ruler = NumberLine(x_range=[0, 9, 3], x_length=6)
web = Graph(["P", "Q"], [("P", "Q")], layout=GraphLayout("spring"))
rose = plane.plot_polar(lambda a: 2)
label = Text("hi").move_by(UP)
link = Pipe(UP, DOWN, color=ORANGE_B)
    frame.add_caption(label)
self.play(p.become(q), run_time=3)
spot = Dot(run_time=1, color=RED)
"""
SECOND = """space = Axes(x_range=[0, 2], z_range=[0, 2]); more = ThreeDAxes(z_range=[0, 1])
centre = Dot(field.inner.get_origin())
self.play(Flash(caption_text))
pairs = make([["P", 'Q']])
step = MoveToTarget(ball, target=goal, run_time=4)
space.add_labels()
box = SurroundingRectangle(axes.c2p(3, 1), 2, 1.5, color=BLUE, fill_opacity=0.2)
group = VGroup(ball, **{'radius': 2})
size = axes.get_axis_range(); other = axes.axis_range; skin = Sphere(ball, texture=ImageTexture("a.png"))
"""


def test_rules(spark):
    code, notes = normalised(spark, FIRST)[0]
    assert code.splitlines() == [
        "ruler = NumberLine(x_range=[0, 9, 3], length=6)",
        'web = Graph(("P", "Q"), [("P", "Q")], layout="spring")',
        "rose = plane.plot_polar_graph(lambda a: 2)",
        'label = Text("hi").shift(UP)',
        "link = Line(UP, DOWN, color=ORANGE)",
        "self.play(p.animate.become(q), run_time=3)",
        "spot = Dot(run_time=1, color=RED)",
    ]
    assert notes[:4] == [
        "replace NumberLine x_length with length", "remove unsupported add_caption calls",
        "animate become calls inside self.play", "replace unsupported ORANGE shade aliases",
    ]


def test_more_rules(spark):
    code, notes = normalised(spark, SECOND)[0]
    assert code.splitlines() == [
        "space = ThreeDAxes(x_range=[0, 2], z_range=[0, 2]); more = ThreeDAxes(z_range=[0, 1])",
        "centre = Dot(ORIGIN)",
        "self.play(Flash(phase_caption))",
        "pairs = make([(\"P\", 'Q')])",
        "step = ball.animate.move_to(goal)",
        "space.add_numbers()",
        "box = Rectangle(width=2, height=1.5, color=BLUE, fill_opacity=0.2).move_to(axes.c2p(3, 1))",
        "group = VGroup(ball)",
        "size = axes.x_range; other = axes.x_range; skin = Sphere(ball)",
    ]
    assert len(notes) == len(set(notes))


def test_line_rules_note_the_first_line(spark):
    late_first = "x.add_labels()\nNumberLine(x_length=1)\nx.add_labels()\n"
    assert normalised(spark, late_first)[0] == (
        "x.add_numbers()\nNumberLine(length=1)\nx.add_numbers()\n",
        ["replace bare add_labels() with add_numbers()", "replace NumberLine x_length with length"],
    )


def test_untouched(spark):
    kept = "a = [1, 2]\r\nb = 3\n\n"
    found = normalised(spark, kept, "", None)
    assert found == {0: (kept, []), 1: ("", []), 2: (None, [])} or found[2][0] is None and found[0] == (kept, [])


def test_run_time_is_kept_in_play(spark):
    code, _ = normalised(spark, "self.play(x, run_time=2)\r\ny = Dot(1, run_time = 3)\r\nz = Dot(1, run_time=3)")[0]
    assert code == "self.play(x, run_time=2)\r\ny = Dot(1, run_time = 3)\r\nz = Dot(1)"


def test_repair(spark):
    code = "self.play(curve.set_points_smoothly(points), ring.become(Dot()))"
    log = "TypeError: Unexpected argument Curve passed to Scene.play()."
    rows = spark.createDataFrame([(1, code, log), (2, code, "other"), (3, code, None), (4, "x = 1", log)], "id int, code string, log string")
    found = {r["id"]: r for r in rewrite.repair_code(rows, "code", "log").collect()}
    assert found[1]["repaired_code"].count(".animate.") == 2 and len(found[1]["repair_notes"]) == 2
    for untouched in (2, 3, 4):
        assert found[untouched]["repaired_code"] == found[untouched]["code"] and found[untouched]["repair_notes"] == []


def test_receivers_of_get_origin_may_end_in_calls_and_indexes(spark):
    found = normalised(spark, "a = f(x)[0].get_origin()", "b = g(x).get_origin()", "c = rows[i].axes.get_origin()", "d = .get_origin()")
    assert [found[i][0] for i in range(4)] == ["a = ORIGIN", "b = ORIGIN", "c = ORIGIN", "d = ORIGIN"]

from tidemark.operators import eventlog as L
from tidemark.operators.simulation import Day, simulate

DDL = "day string, seq long, timestamp string, shopper_id int, action string, row string, col int, details string"


def log(spark, *rows):
    return spark.createDataFrame([(d, k, t, s, a, "a", 1, x) for k, (d, t, s, a, x) in enumerate(rows)], DDL)


def test_video_log_redacts(spark):
    rows = [
        ("Monday", "10:00", 1, "ENTERED", "profile=regular gender=female age=adult speed=2 plan=[A]"), ("Monday", "10:01", 1, "HEADING", "fitting room"),
        ("Monday", "10:02", 1, "NO_PICK", "Denim"), ("Monday", "10:03", 1, "MOVING", "→ checkout"), ("Monday", "10:04", 1, "JOINED_QUEUE", "position #3, 2 item(s)"),
        ("Monday", "10:05", 1, "ENTERED_FITTING", "2 item(s) to try on, waited 4 ticks"), ("Monday", "10:06", 1, "PURCHASED", "1 item(s): A"), ("Monday", "10:07", 1, "ENTERED", None),
    ]
    got = [(r.action, r.details) for r in L.video_log(log(spark, *rows)).orderBy("seq").collect()]
    assert got == [
        ("ENTERED", "gender~female age~adult"), ("BROWSING", "Denim"), ("MOVING", ""), ("JOINED_QUEUE", "position #3"),
        ("ENTERED_FITTING", "waited 4 ticks"), ("CHECKOUT_COMPLETED", ""), ("ENTERED", ""),
    ]


def test_summary_of_a_visit_without_an_exit(spark):
    rows = [
        ("Monday", "10:00", 1, "ENTERED", "gender~male age~young"), ("Monday", "10:01", 1, "ARRIVED_SECTION", "B"), ("Monday", "10:02", 1, "ARRIVED_SECTION", "A"),
        ("Monday", "10:03", 1, "ARRIVED_SECTION", "B"), ("Monday", "10:04", 1, "BROWSING", "B"), ("Monday", "10:05", 1, "JOINED_QUEUE", "position #2"),
        ("Monday", "10:06", 1, "JOINED_QUEUE", "position #1"), ("Monday", "10:07", 1, "ABANDONED_QUEUE", "position #1"), ("Tuesday", "10:00", 1, "ENTERED", ""), ("Tuesday", "24:10", 1, "EXITED", ""),
    ]
    a, b = L.shopper_summary(log(spark, *rows)).orderBy("day").collect()
    assert (a.sections_visited, a.n_sections, a.initial_queue_position, a.funnel_stage, a.exit_time, a.dwell_min) == ("B;A", 2, 2, "queued", None, None)
    assert (b.gender, b.dwell_min, b.funnel_stage, b.purchased, b.n_sections) == (None, 850, "entered_only", False, 0)


def test_days_without_visits_stay_in_the_week(spark):
    s = L.shopper_summary(log(spark, ("Monday", "10:00", 1, "CHECKOUT_COMPLETED", "")))
    got = [(r.day, r.visitors, r.conversion) for r in L.week_conversion(s).collect()]
    assert got[0] == ("Monday", 1, 100.0) and got[6] == ("Sunday", None, None)


def test_simulated_days_are_reproducible_and_sound(spark):
    a, b = Day("Monday", 7, 0.3).run(), Day("Monday", 7, 0.3).run()
    assert a == b and a != Day("Monday", 8, 0.3).run()
    log_ = simulate(spark, [("Monday", 7, 0.3), ("Tuesday", 8, 0.2)])
    s = L.shopper_summary(L.video_log(log_))
    assert s.where("purchased and not reached_counter").count() == 0 and s.where("dwell_min < 0").count() == 0 and s.where("purchased").count() > 0
    assert log_.where("action = 'ENTERED'").count() == s.count()

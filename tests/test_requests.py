from pagelore.operators import requests as rq


def test_only_the_owner_deletes_and_only_once(spark):
    rows = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id long, user_id long")
    asked = spark.createDataFrame([(1, 8, 1), (2, 7, 1), (3, 7, 1), (4, 8, 1), (5, 7, 9), (6, 7, 3)], "request_id long, user_id long, id long")
    kept, answers = rq.delete_owned(asked, rows, ["id"], "Task")
    assert sorted(r.id for r in kept.collect()) == [2, 3]
    assert dict(map(tuple, answers.collect())) == {n: "Task deleted" if n == 2 else "Task not found" for n in range(1, 7)}


def test_a_faq_belongs_to_the_owner_of_its_document(spark):
    faqs = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id long, document_id long")
    docs = spark.createDataFrame([(10, 7), (20, 8)], "id long, owner_id long")
    asked = spark.createDataFrame([(1, 8, 1), (2, 7, 1), (3, 8, 1), (4, 7, 2), (5, 7, 3)], "request_id long, user_id long, id long")
    kept, answers = rq.delete_owned(asked, faqs, ["id"], "FAQ", docs)
    assert sorted(r.id for r in kept.collect()) == [2, 3]
    assert dict(map(tuple, answers.collect())) == {1: "Not authorized", 2: "FAQ deleted", 3: "FAQ not found", 4: "Not authorized", 5: "Not authorized"}


def test_preferences_keep_what_is_not_given(spark):
    stored = spark.createDataFrame([(1, "dark", None, "{}"), (2, "dark", "fr", None)], "user_id long, theme string, language string, preferences_json string")
    updates = spark.createDataFrame([(1, 1, None, "de", None), (2, 1, "light", None, None), (3, 1, None, "es", None), (4, 9, None, None, "{1}")],
                                    "request_id long, user_id long, theme string, language string, preferences_json string")
    got = {r.user_id: (r.theme, r.language, r.preferences_json) for r in rq.upsert_preferences(stored, updates).collect()}
    assert got == {1: ("light", "es", "{}"), 2: ("dark", "fr", None), 9: ("light", "en", "{1}")}


def test_administrators_switch_others(spark):
    users = spark.createDataFrame([(1, "root", "admin", True), (2, "a", "student", True), (3, "b", "student", False)], "id long, username string, role string, is_active boolean")
    asked = spark.createDataFrame([(1, 1, 2, "teacher"), (2, 1, 2, None), (3, 1, 2, None), (4, 1, 3, None), (5, 2, 3, None), (6, 1, 1, None), (7, 1, 1, "student"),
                                   (8, 1, 5, None), (9, 1, 2, "king"), (10, 1, 2, "researcher")], "request_id long, admin_id long, user_id long, role string")
    after, answers = rq.switch_users(asked, users)
    assert {r.id: (r.role, r.is_active) for r in after.collect()} == {1: ("admin", True), 2: ("researcher", True), 3: ("student", True)}
    assert {n: o for n, o in map(tuple, answers.collect()) if o != "ok"} == {
        5: "Role 'student' not authorized", 6: "Cannot deactivate yourself", 7: "Cannot change your own role", 8: "User not found", 9: "Invalid role: king"}

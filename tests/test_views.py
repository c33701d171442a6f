"""The roles as views that SQL can use."""

from shopfloor.sources.roles import TABLE_VIEW_NAMES


def test_roles_are_views(spark, roles_a):
    roles_a.register_views(names=TABLE_VIEW_NAMES)
    for role, view in TABLE_VIEW_NAMES.items():
        assert spark.table(view).count() == getattr(roles_a, role).count()
    first = spark.sql("SELECT min(sid) AS first_sid FROM ser_det_table GROUP BY cid")
    assert first.count() == roles_a.service.select("cid").distinct().count()

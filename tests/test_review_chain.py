"""Owners of review chains: lone juniors, one-person firms, own orders, odd rows."""

from folioscope.operators import govern as G


def test_owners(spark):
    items = spark.createDataFrame([(1, 1, 10), (2, 2, 20), (3, 3, 30), (4, 4, 40), (5, 1, 11), (6, 9, 10), (7, 1, None)], "item_id int, matter_id int, submitter_id int").selectExpr("*", "'x' as user_id", "'clash' as role")
    team = spark.createDataFrame(
        [(1, 10, "associate"), (1, 11, "partner"), (1, 12, "partner"), (1, 13, None), (1, 10, "guest"), (2, 20, "paralegal"), (3, 30, "paralegal"), (4, 40, "managing_partner"), (4, 41, "client")], "matter_id int, user_id int, role string"
    )
    vaults = spark.createDataFrame([(1, 12, 1), (2, 21, 1), (3, 30, 1), (4, None, None)], "matter_id int, owner_id int, firm_id int")
    members = spark.createDataFrame([(30, 1, "managing_partner"), (31, 1, "partner"), (32, 1, "senior_associate"), (33, 1, "partner")], "user_id int, firm_id int, role string")
    got = {r.item_id: (r.first_owner, r.end_owner) for r in G.chain_owners(items, team, vaults, members).collect()}
    assert got == {
        1: (11, 11),  # the nearest above, equal ranks by id
        2: (21, 20),  # a lone junior: the vault's owner
        3: (31, 30),  # who owns the vault as well: the firm's most senior partner but the submitter
        4: (41, 40),  # nobody above: the most senior other member
        5: (12, 11),  # nobody above a partner: the other partner
        6: (None, None),  # no team, no vault
        7: (None, 11),  # without a submitter nothing can be told from self-review
    }
    custom = spark.createDataFrame([(1, 3, 12), (1, 5, 13), (1, 7, 12), (1, 8, 10), (2, 1, 20), (1, 9, None)], "matter_id int, place int, user_id int")
    chain = sorted(map(tuple, G.matter_chain(items, team, custom).where("item_id in (1, 2)").collect()))
    assert chain == [(1, 1, 12, 13), (1, 2, 13, None)]
    assert G.matter_chain(items.where("false"), team, custom).count() == 0 and G.chain_owners(items, team.where("false"), vaults, members.where("false")).count() == 7


def test_teams_are_not_sent_to_every_task_and_an_item_keeps_to_one_matters_order(spark):
    items = spark.createDataFrame([(1, 1, 10), (2, 1, 12), (3, 2, 10), (4, 1, 10), (4, 2, 10)], "item_id int, matter_id int, submitter_id int")
    team = spark.createDataFrame([(1, 10, "associate"), (1, 11, "partner"), (2, 20, "partner"), (2, 10, "paralegal"), (2, 21, "guest")], "matter_id int, user_id int, role string")
    custom = spark.createDataFrame([(1, None, 12), (1, 4, 11)], "matter_id int, place int, user_id int")
    chain = G.matter_chain(items, team, custom)
    assert sorted(map(tuple, chain.collect())) == [(1, 1, 12, 11), (1, 2, 11, None), (2, 1, 11, None), (3, 1, 20, None), (4, 1, 12, 11), (4, 2, 11, None)]
    assert "BroadcastHashJoin" not in chain._jdf.queryExecution().executedPlan().toString()

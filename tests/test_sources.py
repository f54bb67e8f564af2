import json

import pytest

from acrely.schema import LISTING, REQUEST
from acrely.sources import files, pages


def test_csv_keeps_types_and_turns_nan_into_null(spark, tmp_path):
    rows = spark.createDataFrame(
        [("L1", "Pune", "Baner", "Villa", 2, 1, 900.0, float("nan"), None, 3.0, "a|b", 7.0, 100.5, 90450.0)], LISTING)
    files.write_listings_csv(rows, str(tmp_path / "c"))
    got = files.read_listings_csv(spark, str(tmp_path / "c"))
    assert got.schema.simpleString() == LISTING.simpleString()
    row = got.first()
    assert row.age_years is None and row.floor_number is None and row.price == 90450.0


def test_missing_csv_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_listings_csv(spark, str(tmp_path / "nothing")).count()


def test_catalogue_array(spark, tmp_path):
    docs = [{"id": "P1", "title": "T", "price": 12500000, "amenities": ["Gym", "Lift"], "nearby": {"metro": "M 1km"},
             "investment": {"rental_yield": 3.8}}, {"id": "P2"}]
    (tmp_path / "p.json").write_text(json.dumps(docs, indent=1))
    one, two = files.read_catalogue(spark, str(tmp_path / "p.json")).orderBy("id").collect()
    assert one.amenities == ["Gym", "Lift"] and one.nearby.metro == "M 1km" and one.investment.rental_yield == 3.8
    assert two.title is None


def test_inventory_by_id(spark, tmp_path):
    doc = {"P1": {"property_id": "P1", "total_units": 12, "unit_types": [{"type": "A", "area": 10, "available": 2}]},
           "P2": {"property_id": "P2", "price_range": {"min": 1, "max": 2}}}
    (tmp_path / "i.json").write_text(json.dumps(doc, indent=1))
    got = {r.key: r for r in files.read_inventory(spark, str(tmp_path / "i.json")).collect()}
    (tmp_path / "l.json").write_text("\n".join(json.dumps({k: v}) for k, v in doc.items()))
    assert files.read_inventory(spark, str(tmp_path / "l.json"), lines=True).count() == 2
    assert got["P1"].unit_types[0].type == "A" and got["P2"].price_range.max == 2 and got["P2"].total_units is None


def test_cards(spark):
    def card(title, price, area, locality):
        return (f'<div><h2 class="listing-title">{title}</h2><span class="price">{price}</span>'
                f'<span class="area">{area}</span><span class="locality">{locality}</span></div>')

    made = [("1", card(" 2 BHK ", "₹12,34,500", "1350 sqft", " Baner ")), ("2", card("x", "₹1", "1,350 sqft", "y")),
            ("3", card("x", "on request", "10 sqft", "y")), ("4", card(" ", "1", "10", "y")), ("5", "<div></div>")]
    good, bad = pages.split_cards(pages.parse_cards(spark.createDataFrame(made, "card_id string, html string")))
    assert [tuple(r) for r in good.collect()] == [("1", "2 BHK", 1234500, 1350, "Baner")]
    assert {r.card_id: r.problem for r in bad.collect()} == {"2": "area", "3": "price", "4": "title", "5": "title"}


def test_page_facts(spark):
    rows = [(1, "https://a.example:8080/x", "<html><title> T </title><h1>H</h1>" + "x" * 50_000), (2, "bad", "")]
    got = pages.page_facts(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert tuple(got[0]) == (1, "T", "H", "a.example") and tuple(got[1]) == (2, "", "", "")


def test_rows_that_do_not_fit_go_to_quarantine(spark, tmp_path):
    head = ",".join(LISTING.names)
    fine = 'L1,Pune,"Baner, West",Villa,2,1,900.0,NaN,,3.0,a|b,7.0,100.5,90450.0'
    bad = ["L2,Pune,Baner,Villa,two,1,900.0,1,2,3.0,a|b,7.0,100.5,90450.0", "L3,Pune", fine.replace("L1", "L4") + ",more", "??"]
    (tmp_path / "l.csv").write_text("\n".join([head, fine, *bad, fine.replace("L1", "L5"), ""]))
    good, rejected = files.quarantined(files.read_checked(spark, str(tmp_path / "l.csv")))
    assert good.schema.simpleString() == LISTING.simpleString()
    assert {r.property_id: (r.age_years, r.locality) for r in good.collect()} == {"L1": (None, "Baner, West"), "L5": (None, "Baner, West")}
    assert {r[0] for r in rejected.collect()} == set(bad)


def test_json_lines_that_do_not_fit_go_to_quarantine(spark, tmp_path):
    lines = ['{"city": "Pune", "price": 5.5}', '{"city": "Pune", "price": "much"}', '{"city": "Pu', "17", '{"city": null}', "", "[]"]
    (tmp_path / "r.json").write_text("\n".join(lines))
    good, rejected = files.quarantined(files.read_checked(spark, str(tmp_path / "r.json"), REQUEST, "json"))
    assert sorted((r.city or "-", r.price or 0) for r in good.collect()) == [("-", 0), ("Pune", 5.5)]
    assert {r[0] for r in rejected.collect()} == set(lines[1:4])


def test_a_file_without_rows_has_nothing_to_quarantine(spark, tmp_path):
    (tmp_path / "l.csv").write_text(",".join(LISTING.names) + "\n")
    good, rejected = files.quarantined(files.read_checked(spark, str(tmp_path / "l.csv")))
    assert good.isEmpty() and rejected.isEmpty()

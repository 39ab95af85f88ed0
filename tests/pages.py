"""Fetchers that read page files instead of calling an endpoint."""

import json
import uuid
from pathlib import Path


def fetch_page(options, page):
    path = Path(options["endpoint"]) / (f"page={page}.json" if page is not None else "all.json")
    return json.loads(path.read_text()) if path.exists() else []


def fetch_predicate(options, predicate):
    from quillon.sources.rest import soql

    yield {"Id": soql(options, predicate), "attributes": "x", "Amount": 5}


def fetch_counted(options, page):
    """A page, and a file beside it for each call with what was asked."""
    call = Path(options["endpoint"]) / f"call-page={page}-{uuid.uuid4().hex}"
    call.write_text(options.get("params", ""))
    return fetch_page(options, page)


def log(options, part, start, end):
    """A log of a text file per part; each call that reads is noted."""
    folder = Path(options["endpoint"])
    if part is None:
        return {p.stem: len(p.read_text().splitlines()) for p in folder.glob("*.log")}
    (folder / f"read-{part}-{start}-{end}-{uuid.uuid4().hex}").touch()
    return (folder / f"{part}.log").read_text().splitlines()[start:end]


RECORDED = {
    "https://bq/projects/p/datasets": {"datasets": [{"datasetReference": {"datasetId": d}} for d in ("sales", "ops")]},
    "https://bq/projects/p/datasets/sales/tables": {"tables": [{"tableReference": {"tableId": "orders"}}], "nextPageToken": "x"},
    "https://bq/projects/p/datasets/sales/tables?pageToken=x": {"tables": [{"tableReference": {"tableId": "items"}}]},
    "https://bq/projects/p/datasets/sales/tables/orders": {"schema": {"fields": [
        {"name": "id", "type": "INTEGER", "mode": "REQUIRED"}, {"name": "note", "type": "STRING", "maxLength": "40", "defaultValueExpression": "'-'"},
        {"name": "amount", "type": "NUMERIC", "precision": "10", "scale": "2"},
        {"name": "to", "type": "RECORD", "fields": [{"name": "city", "type": "STRING", "mode": "REQUIRED"}]}]}},
    "https://bq/projects/p/datasets/sales/tables/items": {"schema": {"fields": [{"name": "tags", "type": "STRING", "mode": "REPEATED"}]}},
    "https://bq/projects/p/datasets/ops/tables": {},
    "https://sf/services/data/v59.0/sobjects": {"sobjects": [{"name": "Account", "queryable": True}, {"name": "Hidden", "queryable": False}]},
    "https://sf/services/data/v59.0/sobjects/Account/describe": {"fields": [
        {"name": "Id", "type": "id", "nillable": False, "length": 18, "precision": 0, "scale": 0, "defaultValue": None},
        {"name": "Amount", "type": "currency", "nillable": True, "length": 0, "precision": 18, "scale": 2, "defaultValue": 0}]},
}


def recorded(url):
    return RECORDED[url]

"""Answers of a case index, for the data source's tests."""

CASES = {str(n): [{"numeroProcesso": str(n), "grau": g, "id": f"{n}{g}"} for g in ("G1", "G2")] for n in range(10)}


def answer(body: dict) -> dict:
    hits = [d for n in body["query"]["terms"]["numeroProcesso"] for d in CASES.get(n, [])]
    return {"hits": {"total": {"value": len(hits)}, "hits": [{"_id": d["id"], "_source": d | {"partes": ["secret"]}} for d in hits[: body["size"]]]}}

"""Example queries over the test tables, each with the same question asked in SQL."""

from plumbline.gallery import advice, counts, parts, proofs, records, rulings, scan, whole
from plumbline.gallery.base import Query

ALL: dict[str, Query] = {
    **whole.QUERIES,
    **scan.QUERIES,
    **counts.QUERIES,
    **rulings.QUERIES,
    **records.QUERIES,
    **advice.QUERIES,
    **parts.QUERIES,
    **proofs.QUERIES,
}

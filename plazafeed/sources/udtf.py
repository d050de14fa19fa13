"""The SQL face of page extraction: ``SELECT e.* FROM pages, LATERAL page_events(html, url) e``."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

LD = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.S | re.I)


@udtf(returnType="url string, title string, start_date string, venue string, image string")
class PageEvents:
    """One row for each JSON-LD event of a page, nested graphs included; broken blocks are passed over."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        for block in LD.findall(html or ""):
            try:
                todo = [json.loads(block)]
            except ValueError:
                continue
            while todo:
                x = todo.pop(0)
                if isinstance(x, list):
                    todo += x
                elif isinstance(x, dict):
                    todo += x.get("@graph", [])
                    if "event" in str(x.get("@type", "")).lower():
                        place, image = x.get("location"), x.get("image")
                        image = image[0] if isinstance(image, list) and image else image
                        yield url, x.get("name"), x.get("startDate"), place.get("name") if isinstance(place, dict) else place, image.get("url") if isinstance(image, dict) else image


def register(spark: SparkSession) -> None:
    spark.udtf.register("page_events", PageEvents)

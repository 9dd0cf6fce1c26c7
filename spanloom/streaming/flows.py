"""Incremental flows: url discovery, moving ready articles, annotation time, classification of what is new.

Each flow is a stream into foreachBatch or into keyed state. Writing a batch twice gives the same tables, so a restart
after a failure is safe, and a batch rewrites only the buckets of its urls.
"""

import bisect
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from spanloom.operators import articles as A
from spanloom.operators.classifying import classify
from spanloom.operators.logs import CREATE, SELECTIONS
from spanloom.session import cut_lineage
from spanloom.sources.markup import sitemap_urls
from spanloom.sources.store import ParquetStore, TieredStore

# Fixed value: the loss a language model may have before it should be trained again.
MAX_LOSS = 0.15


# U05
def should_retrain(metrics: DataFrame, max_loss=MAX_LOSS, column="loss") -> bool:
    """The mean loss of an evaluation is above the limit."""
    mean = metrics.agg(F.avg(column)).first()[0]
    return mean is not None and mean > max_loss


def unscraped(urls: DataFrame, columns_of: DataFrame) -> DataFrame:
    """Article rows that only have a url."""
    empty = {f.name: F.lit(None).cast(f.dataType) for f in columns_of.schema.fields if f.name != "url"}
    return urls.select("url").withColumns(empty).select(*columns_of.columns)


# T01
def discover_urls(sitemaps: DataFrame, store: ParquetStore, checkpoint: str, limit=None,
                  on_batch: Callable[[DataFrame], None] = None, should_stop: Callable[[], bool] = None, **rules):
    """Saves the unknown urls of a stream of sitemaps (column xml) as unscraped articles, and runs to the end of the input.

    Every unknown url is saved, so none is lost when a batch is passed over. ``on_batch`` gets each batch of new urls, in
    all ``limit`` of them at most in one run; once ``should_stop`` says so, or the limit is reached, later urls are saved
    but not handed on. They wait in the store as unscraped. Returns how many urls were handed on.
    """
    if limit is not None and limit <= 0:
        raise ValueError("the crawl limit must be positive")
    state = {"handed": 0}

    def step(batch: DataFrame, _batch_id: int):
        fresh = cut_lineage(store.filter_known_urls(batch))
        if fresh.isEmpty():
            return
        store.save(unscraped(fresh, store.rows()))
        if should_stop is not None and should_stop():
            return
        if limit is not None:
            left = limit - state["handed"]
            if left <= 0:
                return
            fresh = fresh.orderBy("url").limit(left)
        state["handed"] += fresh.count()
        if on_batch is not None:
            on_batch(fresh)

    urls = sitemap_urls(sitemaps, **rules)
    query = urls.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return state["handed"]


# T02
def move_stream(articles: DataFrame, store: TieredStore, checkpoint: str):
    """Saves a stream of articles in the hot tier and moves what is ready to the cold one after each batch."""
    def step(batch: DataFrame, _batch_id: int):
        store.save(batch)
        store.move()

    query = articles.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# T03
OUT_SCHEMA = "user string, document string, line_no bigint, seconds double, revision bigint"
LINES_PER_PAGE = 256
PAGE_SCHEMA = (
    "lines array<bigint>, times array<bigint>, begins array<boolean>, actions array<string>, told array<bigint>, "
    "seconds array<double>, open_picked bigint, open_actions array<string>, open_times array<bigint>"
)
BOOK_SCHEMA = (
    "pages array<bigint>, revision bigint, latest bigint, timer bigint, open_picked bigint, open_actions array<string>, "
    "open_times array<bigint>"
)
NOTHING_OPEN = (None, (), ())


def _spans(rows, opened=NOTHING_OPEN):
    """{line_no: seconds} of the spans created along rows (line_no, microseconds, is a start, action) in line order, and
    what is open after them: the start of a selection no span was made of yet, and the starts of unfinished actions."""
    picked, starts, out = opened[0], dict(zip(opened[1], opened[2])), {}
    for line, time, begin, action in rows:
        if begin:
            starts[action] = time
        elif action in starts:
            begun = starts.pop(action)
            if action in SELECTIONS:
                picked = begun
            elif picked is not None:
                out[line] = (time - picked) / 1e6
                picked = None
    return out, (picked, tuple(sorted(starts)), tuple(starts[a] for a in sorted(starts)))


class SpanTimes(StatefulProcessor):
    """Follows one user in one document.

    Its lines are kept in order in pages of about equally many, however far apart their numbers are, each with the spans
    told of it and with what is open after its last line. New lines change their own pages; the pages after them are only
    gone through as long as what is open changes. The book has the line each page begins with (the first one also takes
    what lies before), what was open before the first of them, and the latest time seen.
    """

    def __init__(self, settle, expire_ms, lines_per_page):
        self.settle, self.expire_ms, self.lines_per_page = settle, expire_ms, lines_per_page

    def init(self, handle):
        self.handle = handle
        self.pages = handle.getMapState("runs", "begin bigint", PAGE_SCHEMA)
        self.book = handle.getValueState("book", BOOK_SCHEMA)

    def _page(self, number):
        lines, times, begins, actions, told, seconds, *opened = self.pages.getValue((number,))
        return list(zip(lines, times, begins, actions)), dict(zip(told, seconds)), _opened(opened)

    def _book(self):
        if not self.book.exists():
            return [], 0, None, None, NOTHING_OPEN
        numbers, revision, latest, timer, *opened = self.book.get()
        return list(numbers), revision, latest, timer, _opened(opened)

    def _put(self, number, rows, spans, opened):
        columns = [list(x) for x in zip(*rows)] or [[], [], [], []]
        self.pages.updateValue((number,), (*columns, list(spans), list(spans.values()), *_stored(opened)))

    def _parts(self, rows):
        """Lines in order as runs of about equally many, none of which begins with the last line of the one before."""
        size = self.lines_per_page
        starts = [0]
        for at in range(size, len(rows) - size, size) if len(rows) > 2 * size else ():
            while at < len(rows) and rows[at][0] == rows[at - 1][0]:
                at += 1
            if starts[-1] < at < len(rows):
                starts.append(at)
        return [rows[a:b] for a, b in zip(starts, [*starts[1:], len(rows)])]

    def handleInputRows(self, key, rows, timerValues):
        given, latest = [], 0
        for line, micros, begin, action in ((r["line_no"], r["micros"], r["state"] == "START", r["action"]) for r in rows):
            latest = max(latest, micros // 1000)
            if action in SELECTIONS or action == CREATE:
                given.append((line, micros, begin, action))
        numbers, revision, seen, timer, before = self._book()
        latest = latest if seen is None else max(latest, seen)
        fresh = not numbers  # the first page is not there yet
        if fresh and given:
            numbers = [min(given)[0]]
        new = defaultdict(set)
        for row in given:
            new[numbers[max(0, bisect.bisect_right(numbers, row[0]) - 1)]].add(row)
        revision += 1
        told, carried = [], False
        at = bisect.bisect_left(numbers, min(new)) if new else len(numbers)
        opened = self._page(numbers[at - 1])[2] if 0 < at < len(numbers) else before
        while at < len(numbers):
            number = numbers[at]
            if number in new or carried:
                known, spans, left = ([], {}, opened) if fresh else self._page(number)
                known = sorted({*known, *new.pop(number, ())})
                after, parts = {}, self._parts(known)
                begins = [min(number, known[0][0]), *(part[0][0] for part in parts[1:])]
                if number not in begins and not fresh:
                    self.pages.removeKey((number,))
                for begin, part in zip(begins, parts):
                    found, opened = _spans(part, opened)
                    after |= found
                    self._put(begin, part, found, opened)
                told += [(line, None) for line in spans if line not in after]
                told += [(line, after[line]) for line in after if spans.get(line) != after[line]]
                carried = opened != left
                numbers[at : at + 1] = begins
                at += len(begins)
            elif new:  # on to the next page with new lines
                at = bisect.bisect_left(numbers, min(new))
                opened = self._page(numbers[at - 1])[2]
            else:
                break
        if self.settle:
            numbers, before = self._settled(numbers, before, timerValues.getCurrentWatermarkInMs())
            timer = self._wait(timer, latest + 1 if numbers else latest + (self.expire_ms or 1))
        self.book.update((numbers, revision, latest, timer, *_stored(before)))
        for line, seconds in told:
            yield Row(user=key[0], document=key[1], line_no=line, seconds=seconds, revision=revision)

    def _settled(self, numbers, before, watermark):
        """Drops the first pages as long as all their lines lie behind the watermark; keeps what they leave open."""
        while numbers:
            rows, _, opened = self._page(numbers[0])
            if any(time >= watermark * 1000 for _, time, _, _ in rows):
                break
            before = opened
            self.pages.removeKey((numbers.pop(0),))
        return numbers, before

    def _wait(self, timer, until):
        if timer is not None and timer != until:
            self.handle.deleteTimer(timer)
        if timer != until:
            self.handle.registerTimer(until)
        return until

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.book.exists():
            numbers, revision, latest, _, before = self._book()
            watermark = timerValues.getCurrentWatermarkInMs()
            if self.expire_ms is not None and watermark >= latest + self.expire_ms:
                self.book.clear()
                self.pages.clear()
            else:
                numbers, before = self._settled(numbers, before, watermark)
                timer = None
                if self.expire_ms is not None:
                    timer = self._wait(None, latest + self.expire_ms)
                self.book.update((numbers, revision, latest, timer, *_stored(before)))
        yield from ()

    def close(self):
        pass


def _opened(stored):
    return stored[0], tuple(stored[1]), tuple(stored[2])


def _stored(opened):
    return opened[0], list(opened[1]), list(opened[2])


def annotation_time_stream(
    log: DataFrame, lateness: str | None = None, expire_ms: int | None = None, lines_per_page=LINES_PER_PAGE
) -> DataFrame:
    """Seconds per created span, as a stream, from a stream of log rows with line_no, time, user, document, state, action.

    Rows may come in any order and be split into batches anyhow: a late row changes what was told before, by a row with a
    higher revision, whose seconds are null if there is no span after all; ``latest_spans`` takes the last revisions.
    A batch costs what its own lines and the spans they change cost, not what was seen before.

    Nothing is forgotten, so the state grows with the log. With ``lateness`` rows further behind the latest time seen are
    dropped, and lines go once they and all before them are that far behind; what they leave open is kept, and a line that
    comes with a smaller number later counts as following them. With ``expire_ms`` besides, users who do nothing in a
    document for that long start anew. The state is kept by RocksDB, which is set for the session.
    """
    if expire_ms is not None and lateness is None:
        raise ValueError("an expiry needs a lateness")
    log.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    micros = F.unix_micros(F.col("time").cast("timestamp")).alias("micros")
    rows = log.select("line_no", "time", micros, "user", "document", "state", "action")
    if lateness is not None:
        rows = rows.withWatermark("time", lateness)
    return rows.groupBy("user", "document").transformWithState(
        SpanTimes(lateness is not None, expire_ms, lines_per_page),
        OUT_SCHEMA,
        "Append",
        "EventTime" if lateness else "None",
    )


def latest_spans(told: DataFrame) -> DataFrame:
    """(user, document, line_no, seconds): the last revision of every span in the written stream that still stands."""
    last = told.groupBy("user", "document", "line_no").agg(F.max_by("seconds", "revision").alias("seconds"))
    return last.filter("seconds IS NOT NULL")


# T04
def classify_stream(articles: DataFrame, store: ParquetStore, scorer, kind: str, labels, checkpoint: str, text_columns=("title",)):
    """Labels what waits for a label in each batch of a stream of articles and saves the result."""
    column = {"relevance": "label_relevance", "service": "label_service"}[kind]

    def step(batch: DataFrame, _batch_id: int):
        rows = A.backfill_service(batch) if kind == "service" else batch
        waiting = A.pending(rows, kind)
        done = classify(waiting, scorer, kind, labels, column, text_columns).drop("scores")
        others = rows.join(waiting.select("url"), "url", "left_anti")
        store.save(done.select(*rows.columns).unionByName(others))

    query = articles.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

"""Parameters of the registered queries.

The reference's collection limits (50 videos/channel, 200 rows/video, pages of
100, 300 posts/account, target 5,000) are the defaults of the operators.  At
the driver's test scale those limits would never bite, so the registered
queries use the scaled-down values below (chosen once, documented in
FIXTURES.md) — they are the cap *features* under test, not row caps to make
a query cheap.
"""

VIDEOS_PER_CHANNEL = 3
ROWS_PER_VIDEO = 12
PAGE_SIZE = 2
POSTS_PER_ACCOUNT = 20
TOTAL_TARGET = 300
MILESTONE = 100
ANNOTATOR = 0
ANNOTATORS = (0, 1)
ANNOTATOR_NAME = "annotator_0"
# Key of the registered query over synthetic names. Releases take theirs from the session (operators.release.release_key).
FIXTURE_KEY = "not a secret"
RUN_STARTED, RUN_ENDED = "2024-03-30T22:00:00+00:00", "2024-04-01T01:00:00+00:00"
METHOD = {"source": "archived payloads", "comment_order": "relevance", "replies_collected": "true"}
SCRAPED_AT = "2024-04-01T00:00:00+00:00"
EXPORT_DATE = "2024-04-02"
RATE_WINDOW = "1 day"
RATE_DELAY = "0 seconds"

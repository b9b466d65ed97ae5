"""Schemas of posts and of the files around them."""

# Field names of the public post format.
USER_FIELDS = [
    "screen_name", "followers_count", "friends_count", "listed_count",
    "created_at", "statuses_count", "location",
]

USER = (
    "struct<id: bigint, id_str: string, screen_name: string, followers_count: bigint, "
    "friends_count: bigint, listed_count: bigint, created_at: string, statuses_count: bigint, "
    "location: string>"
)
INNER = (
    "struct<id: bigint, id_str: string, created_at: string, full_text: string, "
    "display_text_range: array<int>, user: struct<screen_name: string>>"
)
POST = (
    "id bigint, id_str string, created_at string, full_text string, text string, "
    "truncated boolean, display_text_range array<int>, lang string, source string, "
    "is_quote_status boolean, in_reply_to_status_id bigint, in_reply_to_status_id_str string, "
    f"in_reply_to_screen_name string, user {USER}, quoted_status {INNER}, retweeted_status {INNER}"
)

# Post id -> ids of the users who reposted it.
MAP_OF_LISTS = "map<string, array<bigint>>"

"""Social posts: reshaping, thread assembly and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import one_each
from ..functions.text import escape_html
from ..session import kept

_VARIANTS = "array<struct<content_type:string,bitrate:bigint,url:string>>"
_MEDIA = f"array<struct<type:string,media_url_https:string,video_info:struct<variants:{_VARIANTS}>>>"
_USER = "struct<name:string,screen_name:string>"
SYNDICATED = f"struct<id_str:string,text:string,user:{_USER},created_at:string,favorite_count:bigint,conversation_count:bigint,in_reply_to_screen_name:string,in_reply_to_status_id_str:string,mediaDetails:{_MEDIA},quoted_tweet:struct<user:{_USER},text:string>>"
MAX_ANCESTORS = 50


def best_variant(variants: Column) -> Column:
    """The URL of the MP4 of the highest bit rate; the first of equals."""
    mp4 = F.filter(variants, lambda v: (v["content_type"] == "video/mp4") & v["url"].isNotNull())
    placed = F.transform(mp4, lambda v, i: F.struct(F.coalesce(v["bitrate"], F.lit(0)).alias("rate"), (-i).alias("place"), v["url"].alias("url")))
    return F.array_max(placed)["url"]


def reshaped(body: Column) -> Column:
    """A syndicated post as struct(id, text, author, created_at, likes, replies, replying_to, replying_to_status, photos, videos, quote); null without an id."""
    p = F.from_json(body, SYNDICATED)
    media = F.coalesce(p["mediaDetails"], F.array().cast(_MEDIA))
    photos = F.transform(F.filter(media, lambda m: (m["type"] == "photo") & m["media_url_https"].isNotNull()), lambda m: m["media_url_https"])
    films = F.filter(media, lambda m: m["type"].isin("video", "animated_gif") & m["video_info"].isNotNull())
    videos = F.transform(films, lambda m: F.struct(m["media_url_https"].alias("thumbnail_url"), best_variant(m["video_info"]["variants"]).alias("url")))
    quote = F.when(p["quoted_tweet"].isNotNull(), F.struct(p["quoted_tweet"]["user"].alias("author"), p["quoted_tweet"]["text"].alias("text")))
    fields = {"id": p["id_str"], "text": F.coalesce(p["text"], F.lit("")), "author": p["user"], "created_at": p["created_at"], "likes": p["favorite_count"], "replies": p["conversation_count"], "replying_to": p["in_reply_to_screen_name"], "replying_to_status": p["in_reply_to_status_id_str"], "photos": photos, "videos": videos, "quote": quote}
    return F.when(p["id_str"].isNotNull(), F.struct(*(c.alias(k) for k, c in fields.items())))


def threads(posts: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id, place) of every target's thread: replies of its author to itself upward, then the rest of the conversation.

    ``posts``: id, author, replying_to, replying_to_status, conversation_id. A post
    points at the one it replies to; pointers along replies to one name are doubled, so
    all targets' walks of up to MAX_ANCESTORS steps take six joins. Of posts of one id
    the least counts; a walk that comes round ends.
    """
    p = one_each(posts.select("id", "author", "replying_to", "replying_to_status", "conversation_id"), "id")
    whom = F.lower("replying_to")
    links = p.where("replying_to is not null").select(F.col("id").alias("x"), whom.alias("whom"), F.col("replying_to_status").alias("y"))
    jump = kept(links.join(p.select(F.col("id").alias("y")), "y").select("x", "whom", "y"))  # to a post that is there
    at = targets.select(F.col("id").alias("target")).distinct().join(p, F.col("target") == p.id)
    found = at.select("target", "id", F.lower("author").alias("who"), F.lit(0).alias("step"))
    for power in range(MAX_ANCESTORS.bit_length()):
        up = found.join(jump, (F.col("id") == F.col("x")) & (F.col("who") == F.col("whom")))
        found = found.union(up.select("target", F.col("y").alias("id"), "who", (F.col("step") + (1 << power)).alias("step")))
        far = jump.select(F.col("x").alias("y"), F.col("whom").alias("next"), F.col("y").alias("z"))
        jump = kept(jump.join(far, "y").where("whom = next").select("x", "whom", F.col("z").alias("y")))
    found = kept(found.where(F.col("step") <= MAX_ANCESTORS).groupBy("target", "id").agg(F.min("step").alias("step")))
    roots = found.groupBy("target").agg(F.max_by("id", "step").alias("root"))
    below = roots.join(p, roots.root == p.conversation_id).select("target", "id").join(found.select("target", "id"), ["target", "id"], "left_anti")
    every = found.select("target", "id").union(below)
    sorted_ids = F.array_sort(F.collect_list(F.struct(F.length("id").alias("n"), F.col("id").alias("id"))))
    return every.groupBy("target").agg(sorted_ids.alias("s")).select("target", F.posexplode("s").alias("place", "x")).select("target", F.col("x.id").alias("id"), "place")


def section(post: Column) -> Column:
    """A post as an HTML section: text, photos, videos, quote."""
    br = lambda c: F.replace(escape_html(c), F.lit("\n"), F.lit("<br>"))
    text = F.trim(post["text"])
    photos = F.transform(F.filter(post["photos"], lambda u: u != ""), lambda u: F.concat(F.lit('<figure><img src="'), escape_html(u), F.lit('" /></figure>')))
    videos = F.transform(F.filter(post["videos"], lambda v: F.coalesce(v["thumbnail_url"], F.lit("")) != ""), lambda v: F.concat(F.lit('<figure><img src="'), escape_html(v["thumbnail_url"]), F.lit('" /><figcaption>Video: '), escape_html(F.coalesce(v["url"], F.lit(""))), F.lit("</figcaption></figure>")))
    q = post["quote"]
    blank = lambda c: F.coalesce(c, F.lit(""))
    quote = F.when(q.isNotNull(), F.concat(F.lit("<blockquote><p><strong>"), escape_html(blank(q["author"]["name"])), F.lit(" (@"), escape_html(blank(q["author"]["screen_name"])), F.lit(")</strong></p><p>"), br(blank(q["text"])), F.lit("</p></blockquote>"))).otherwise("")
    return F.concat(F.lit("<section>"), F.when(text != "", F.concat(F.lit("<p>"), br(text), F.lit("</p>"))).otherwise(""), F.array_join(photos, ""), F.array_join(videos, ""), quote, F.lit("</section>"))


def thread_pages(posts: DataFrame, members: DataFrame) -> DataFrame:
    """(target, html): each thread's posts in order under a title of its first author."""
    made = members.join(posts.select(F.col("post.id").alias("id"), "post"), "id").groupBy("target").agg(F.array_sort(F.collect_list(F.struct("place", section(F.col("post")).alias("s"), F.col("post.author").alias("a"), F.col("post.created_at").alias("c"), F.col("post.likes").alias("l"), F.col("post.replies").alias("r")))).alias("x"))
    first = F.col("x")[0]
    head = F.concat(escape_html(F.coalesce(first["a"]["name"], F.lit(""))), F.lit(" (@"), escape_html(F.coalesce(first["a"]["screen_name"], F.lit(""))), F.lit(")"))
    many = F.size("x") > 1
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    foot = F.concat(F.when(first["c"].isNotNull(), F.concat(F.lit("<time>"), escape_html(first["c"]), F.lit("</time> · "))).otherwise(""), F.when(many, F.concat(F.size("x").cast("string"), F.lit(" tweets · "))).otherwise(""), n(first["r"]), F.lit(" replies · "), n(first["l"]), F.lit(" likes"))
    html = F.concat(F.lit("<html><head><title>"), head, F.lit(" on X</title></head><body><article><h1>"), head, F.when(many, " — Thread").otherwise(""), F.lit("</h1>"), F.array_join(F.transform("x", lambda p: p["s"]), ""), F.lit("<footer>"), foot, F.lit("</footer></article></body></html>"))
    return made.select("target", html.alias("html"))


def article_html(blocks: DataFrame, entities: DataFrame) -> DataFrame:
    """(article, html) of blocks (article, pos, type, text, entity_key), with entities (article, entity_key, url) for atomic ones.

    Ordered items are numbered in the order of the article's blocks.
    """
    made = blocks.join(entities.withColumnRenamed("url", "entity_url"), ["article", "entity_key"], "left")
    safe = escape_html(F.coalesce("text", F.lit("")))
    tag = F.when(F.col("type") == "header-one", "h2").when(F.col("type") == "header-two", "h3").when(F.col("type") == "header-three", "h4").when(F.col("type") == "blockquote", "blockquote").otherwise("p")
    ordered = F.col("type") == "ordered-list-item"
    items = F.array_sort(F.collect_list(F.struct("pos", tag.alias("tag"), "type", safe.alias("text"), F.coalesce("entity_url", F.lit("")).alias("url"), ordered.cast("int").alias("o"))))
    grouped = made.groupBy("article").agg(items.alias("x"))

    def one(b, i):
        number = F.aggregate(F.slice("x", 1, i + 1), F.lit(0), lambda a, y: a + y["o"])
        plain = F.concat(F.lit("<"), b["tag"], F.lit(">"), b["text"], F.lit("</"), b["tag"], F.lit(">"))
        image = F.when(b["url"] != "", F.concat(F.lit('<figure><img src="'), escape_html(b["url"]), F.lit('" /></figure>'))).otherwise("")
        return F.when(b["type"] == "atomic", image).when(b["o"] == 1, F.concat(F.lit("<p>"), number.cast("string"), F.lit(". "), b["text"], F.lit("</p>"))).when(b["type"] == "unordered-list-item", F.concat(F.lit("<p>• "), b["text"], F.lit("</p>"))).otherwise(plain)

    return grouped.select("article", F.concat(F.lit("<article>"), F.array_join(F.transform("x", one), ""), F.lit("</article>")).alias("html"))


"""Posts derived from the test tables: raw posts, stored answers, ticket log.

Conversation turns become posts (the assistant is the official account, a turn
replies to the one before it) and documents become long stand-alone posts.  A
case number per row adds a typical opening phrase and a classifier's answer.
The statement is portable SQL so that a check can run the very same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Placeholders: <string> the string type, <time> a time in ISO form, <tweet_time>
# the weekday form, <conversations> and <documents> the tables.
POSTS_SQL = """
SELECT seq AS _seq,
       CASE WHEN k = 10 AND turn > 0 THEN CAST(seq - 1 AS <string>)
            ELSE CAST(seq AS <string>) END AS id,
       CASE k WHEN 10 THEN 'bad date' WHEN 13 THEN <tweet_time> ELSE <time> END AS created_at,
       CASE WHEN k = 14 THEN NULL ELSE
       CASE k WHEN 0 THEN 'Panne fibre @Freebox depuis 2 jours, scandale http://t.co/ab1 '
              WHEN 1 THEN 'RT Merci Free... quelle honte '
              WHEN 2 THEN 'Freebox: je veux RÉSILIER tout de suite, arnaque '
              WHEN 3 THEN 'Bravo   free mobile, 5G au top www.free.fr '
              WHEN 4 THEN 'Débit lent ce soir, réseau instable #free '
              WHEN 5 THEN 'Facture free fausse, remboursement SVP '
              WHEN 6 THEN 'Le SAV de free ne répond pas, hotline nulle '
              WHEN 7 THEN 'Le replay de la chaîne ne marche pas sur ma freebox '
              WHEN 8 THEN 'Bonjour tout le monde '
              WHEN 9 THEN 'Merci pour le décodeur, génial ! '
              WHEN 12 THEN 'Une idée pour free : un mode nuit sur le replay '
              WHEN 13 THEN 'Est-ce que free couvre mon village en fibre ? '
              WHEN 15 THEN 'Merci free, conseiller super, nickel '
              ELSE '' END || text END AS full_text,
       screen_name,
       'Compte ' || screen_name AS name,
       CASE WHEN k = 9 THEN ' ' ELSE 'img/' || screen_name END AS profile_image_url,
       CAST(seq % 997 AS <string>) AS user_id,
       CASE WHEN k NOT IN (1, 3) THEN reply_to END AS in_reply_to_status_id,
       CASE WHEN k NOT IN (1, 3) THEN reply_to END AS in_reply_to,
       CASE WHEN k = 1 THEN shared END AS retweeted_status,
       CASE WHEN k = 3 THEN shared END AS quoted_status,
       CASE WHEN k = 3 THEN 'True' ELSE 'False' END AS is_quote_status,
       CASE WHEN k = 11 THEN 'n/a' ELSE CAST(seq * 4847 % 2000000 AS <string>) END
           AS favorite_count,
       CAST(seq * 353 % 3000 AS <string>) AS retweet_count,
       CASE WHEN k = 8 THEN NULL ELSE CAST(seq % 50 * 25 AS <string>) END AS reply_count,
       CAST(seq * 1250 % 90000000 AS <string>) AS views_count,
       CASE k WHEN 0 THEN '{"intent":"complaint","complaint_type":"network_outage","sentiment":"negative","sarcasm":false,"priority":"high","explanation":"panne"}'
              WHEN 2 THEN '{"intent":"complaint","complaint_type":"none","sentiment":"negative","sarcasm":false,"priority":"low","explanation":"depart"}'
              WHEN 3 THEN 'Voici : {"intent":"praise","sentiment":"positive","sarcasm":false} fin'
              WHEN 4 THEN 'pas de json'
              WHEN 5 THEN '{"intent":"complaint","complaint_type":"billing_issue","sentiment":"negative","sarcasm":"true","priority":"urgent","explanation":"x"}'
              WHEN 6 THEN '{"intent":"other","complaint_type":"none","sentiment":"neutral","sarcasm":false,"priority":"none"}'
              WHEN 7 THEN '[1, 2]'
              WHEN 9 THEN '{"intent":"thanks","complaint_type":"none","sentiment":"positive","sarcasm":true,"priority":"none","explanation":null}'
              WHEN 10 THEN '{"intent":"complaint"} {"intent":"thanks"}'
              WHEN 12 THEN '{"intent":"suggestion","sentiment":"neutral","explanation":"une idee"}'
              WHEN 13 THEN '{"intent":"question","sentiment":"neutral",}'
              WHEN 15 THEN '{"intent":"thanks","sentiment":"positive","sarcasm":false,"priority":"none"}'
              ELSE '{"intent":"other"}' END AS llm_response
FROM (
  SELECT conv_id * 100 + turn AS seq, turn, text,
         (conv_id * 31 + turn * 7) % 16 AS k,
         conv_id * 5 + turn AS hours,
         CASE WHEN role = 'assistant' THEN 'Freebox'
              WHEN role = 'system' THEN 'UniversFreebox'
              ELSE 'client' || CAST(conv_id % 50 AS <string>) END AS screen_name,
         CASE WHEN turn > 0 THEN CAST(conv_id * 100 + turn - 1 AS <string>) END AS reply_to,
         CASE WHEN conv_id > 0 THEN CAST((conv_id - 1) * 100 AS <string>) END AS shared
  FROM <conversations>
  UNION ALL
  SELECT 1000000000000 + doc_id AS seq, 0 AS turn, text,
         doc_id % 16 AS k,
         doc_id % 720 AS hours,
         source AS screen_name,
         CASE WHEN doc_id % 16 = 6 THEN '0' END AS reply_to,
         CASE WHEN doc_id % 16 = 1 THEN '0'
              ELSE 'gone' || CAST(doc_id AS <string>) END AS shared
  FROM <documents>
) p
"""

TICKET_LOG_SQL = """
SELECT CAST(user_id % 100 * 100 AS <string>) AS ticket_id, ts, event_id,
       CASE WHEN event_type IN ('view', 'click') THEN 'Nouveau'
            WHEN event_type = 'error' THEN 'En cours' ELSE 'Résolu' END AS status,
       props AS note
FROM <events>
"""

_TIME = "timestampadd(HOUR, CAST(hours AS INT), TIMESTAMP'2024-01-01 00:00:00')"


def _spark_sql(statement: str, sf_dir: str) -> str:
    swaps = {
        "<string>": "STRING",
        "<time>": f"date_format({_TIME}, 'yyyy-MM-dd HH:mm:ss')",
        "<tweet_time>": f"date_format({_TIME}, 'EEE MMM dd HH:mm:ss') || ' +0000 ' || "
                        f"date_format({_TIME}, 'yyyy')",
    }
    for table in ("conversations", "documents", "events"):
        swaps[f"<{table}>"] = f"parquet.`{sf_dir}/{table}.parquet`"
    for mark, text in swaps.items():
        statement = statement.replace(mark, text)
    return statement


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts with ``_seq``; without the stored answers."""
    return spark.sql(_spark_sql(POSTS_SQL, sf_dir)).drop("llm_response")


def stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(_seq, id, llm_response)``; an id can occur more than once."""
    return spark.sql(_spark_sql(POSTS_SQL, sf_dir)).select("_seq", "id", "llm_response")


def ticket_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only log of ticket status changes."""
    return spark.sql(_spark_sql(TICKET_LOG_SQL, sf_dir))

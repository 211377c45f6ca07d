"""The derived tables of ``moneytrail.sources.views`` spelled for DuckDB, as common table expressions."""

VIEWS = {
    "transactions": """
SELECT event_id AS id,
  TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 24 AS BIGINT)) AS ts,
  'ACC' || user_id AS sender_account,
  CASE WHEN event_type IN ('purchase','view','click') THEN 'ACC' || CAST(json_extract_string(props,'$.k') AS INT) ELSE 'ACC' || user_id END AS receiver_account,
  CASE event_type WHEN 'signup' THEN 'deposit' WHEN 'error' THEN 'withdraw' ELSE 'transfer' END AS transaction_type,
  CAST(CASE WHEN user_id % 5 = 0 THEN round(value * 6, 2) WHEN event_id % 10 = 0 THEN round(value / 5) * 1000 ELSE round(value * 200, 2) END AS DECIMAL(18,2)) AS amount,
  (['online','mobile','atm','branch','card','ach','wire','swift','pos','api'])[CAST((event_id + user_id) % 10 AS INT) + 1] AS channel,
  (['ZW','ZW','ZW','ZW','US','GB','ZA','AE','NG','IR','RU','KY'])[CAST((event_id * 7 + user_id) % 12 AS INT) + 1] AS destination_country
FROM events""",
    "order_transactions": """
SELECT o_orderkey AS id, o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS INT)) AS ts,
  'ACC' || o_custkey AS sender_account,
  CASE WHEN o_orderstatus = 'O' THEN 'ACC' || ((o_custkey * 7 + o_orderkey) % 150) ELSE 'ACC' || o_custkey END AS receiver_account,
  CASE o_orderstatus WHEN 'O' THEN 'transfer' WHEN 'F' THEN 'deposit' ELSE 'withdraw' END AS transaction_type,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  (['online','mobile','atm','branch','card','ach','wire','swift','pos','api'])[CAST((o_orderkey + o_custkey) % 10 AS INT) + 1] AS channel,
  (['ZW','ZW','ZW','ZW','US','GB','ZA','AE','NG','IR','RU','KY'])[CAST((o_orderkey * 7 + o_custkey) % 12 AS INT) + 1] AS destination_country
FROM orders""",
    "accounts": """
SELECT c_custkey AS id, 'ACC' || c_custkey AS account_number,
  (['Tendai','Amina','Bruno','Chipo','Dmitri','Elena','Farai','Grace','Hassan','Ines','Jonas','Kudzai','Leila','Marko','Nyasha','Olga','Pedro','Rudo','Selim','Tariro'])[CAST(c_custkey % 20 AS INT) + 1] || ' ' ||
  (['Moyo','Okafor','Petrov','Silva','Ncube','Haddad','Larsen','Dube','Ortega','Banda','Keller','Sibanda','Rossi','Mutasa','Novak','Phiri','Almeida','Chirwa','Vargas','Zulu'])[CAST((c_custkey // 20) % 20 AS INT) + 1] AS username,
  lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || 'A' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS id_number,
  CAST(c_acctbal * 10 AS DECIMAL(18,2)) AS balance,
  CASE WHEN c_custkey % 7 = 0 THEN 'pending' WHEN c_custkey % 31 = 0 THEN 'rejected' ELSE 'verified' END AS kyc_status,
  c_custkey % 37 = 0 AS pep_flag,
  CASE WHEN c_custkey % 11 = 0 THEN 'high' WHEN c_custkey % 5 = 0 THEN 'medium' ELSE 'standard' END AS risk_rating,
  CASE WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 6000 THEN 'average' WHEN c_acctbal < 9000 THEN 'high' ELSE 'ultra_high' END AS wealth_segment,
  TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(c_custkey % 365 AS INT)) AS created_at
FROM customer""",
    "watchlist": """
SELECT s_suppkey AS id,
  CASE s_suppkey % 4 WHEN 0 THEN a.username WHEN 1 THEN replace(a.username,'o','a') WHEN 2 THEN split_part(a.username,' ',2) || ' ' || split_part(a.username,' ',1) ELSE 'Entity ' || s_suppkey END AS name,
  CASE WHEN s_suppkey % 4 = 3 AND s_suppkey % 8 = 3 THEN a.id_number END AS id_number,
  CASE WHEN s_suppkey % 8 = 7 THEN lower(a.account_number) END AS account_number,
  (['sanctions','pep','internal','adverse_media'])[CAST((s_suppkey // 4) % 4 AS INT) + 1] AS list_type
FROM supplier JOIN accounts a ON a.id = (s_suppkey * 13 + 3) % 150""",
    "raw_transactions": """
SELECT id,
  CASE WHEN id % 50 = 0 THEN NULL WHEN id % 51 = 0 THEN 'abc' WHEN id % 53 = 0 THEN '-' || amount WHEN id % 71 = 0 THEN '10000000000' ELSE CAST(amount AS VARCHAR) END AS amount,
  CASE WHEN id % 57 = 0 THEN 'invalid-date' WHEN id % 73 = 0 THEN NULL WHEN id % 79 = 0 THEN '1999-12-31T23:59:59' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS timestamp,
  CASE WHEN id % 59 = 0 THEN 'barter' WHEN id % 83 = 0 THEN NULL WHEN id % 3 = 0 THEN ' ' || upper(transaction_type) ELSE transaction_type END AS transaction_type,
  CASE WHEN id % 61 = 0 THEN 'pigeon' WHEN id % 62 = 0 THEN NULL ELSE upper(channel) END AS channel,
  CASE WHEN id % 89 = 0 THEN NULL WHEN id % 97 = 0 THEN '' ELSE sender_account END AS sender_account,
  receiver_account,
  CASE WHEN id % 101 = 0 THEN 'weird' WHEN id % 2 = 0 THEN 'Normal ' END AS risk_level,
  CASE WHEN id % 103 = 0 THEN '150' WHEN id % 107 = 0 THEN 'n/a' WHEN id % 2 = 0 THEN '12.5' END AS risk_score,
  unnest(range(0, CASE WHEN id % 67 = 0 THEN 2 ELSE 1 END)) AS copy_no
FROM transactions""",
    "predictions": """
SELECT id, epoch_us(ts) AS ts_us,
  CASE WHEN amount >= 10000 THEN 'super_suspicious' WHEN amount >= 5000 THEN 'suspicious' ELSE 'normal' END AS predicted,
  CASE WHEN amount + (id % 7) * 1500 >= 12000 THEN 'super_suspicious' WHEN amount + (id % 7) * 1500 >= 7000 THEN 'suspicious' ELSE 'normal' END AS actual,
  0.5::DOUBLE + (id % 50)::DOUBLE / 100 AS confidence, ((id % 41) - 20)::DOUBLE / 100 AS anomaly,
  CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS arm
FROM transactions""",
    "case_actions": """
SELECT id, epoch_us(ts) AS ts_us, id // 50 AS alert_id, 'ACC' || ((id // 50) % 150) AS account_number,
  CASE WHEN transaction_type = 'deposit' THEN 'resolve' WHEN transaction_type = 'withdraw' THEN 'escalate' WHEN id % 3 = 0 THEN 'file_sar' ELSE 'note' END AS action
FROM transactions""",
    "auth_events": """
SELECT event_id AS id, 'user' || user_id AS identifier,
  epoch_us(TIMESTAMP '2024-01-01 00:00:00') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 2000 AS ts_us,
  event_type = 'signup' AS success
FROM events WHERE event_type IN ('error', 'signup')""",
    "model_events": """
SELECT event_id AS id, 'model-' || (event_id % 7) AS model_id, epoch_us(ts) AS ts_us,
  CASE event_type WHEN 'purchase' THEN 'deployed' WHEN 'error' THEN 'undeployed' WHEN 'signup' THEN 'registered' ELSE 'evaluated' END AS action,
  round(value / 500, 4) AS f1, round(value / 400, 4) AS accuracy
FROM events""",
}

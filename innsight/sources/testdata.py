"""Bindings of the analysed hotel schema to the driver's generated tables.

Each binding is a lazy DataFrame derived from the parquet tables in ``sf_dir`` (orders,
lineitem, part, supplier, customer, nation, events, documents, labels), so every analysis
runs over the whole generated data and its work grows with the scale factor. The spellings
below deliberately vary case and accents so that folded matching is exercised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.functions.text import RESORT_CODES
from innsight.sources.catalog import Catalog

# Display spellings of the five resorts (index = priority digit - 1 or user_id % 5).
RESORT_LABELS = ("Resort_Alpha", "resort_béta", "RESORT_GAMMA", "resort_delta", "Resort_Épsilon")
COMPANIES = ("Alfa Hotéis", "Beta Hotelaria", "Gama Resorts", "Delta Lazer", "Épsilon Turismo")
# Departments; the last one is a case/accent variant of the first.
DEPARTMENTS = ("Recepção", "Governança", "Alimentos e Bebidas", "Manutenção", "Lazer", "Eventos", "recepcao")
BUILDINGS = ("Torre A", "Torre B", "Anexo Praia")
FEEDBACK_TYPES = {"error": "Reclamação", "signup": "reclamacao", "view": "Elogio",
                  "click": "Sugestão", "purchase": "Neutro"}
PATIENT_TYPES = {"view": "Hóspede Lazer", "click": "hospede eventos", "purchase": "Emocionador",
                 "signup": "", "error": None}
COMPLAINTS = ("Cefaleia", "Náusea", "Febre", "Entorse", "Queimadura solar")
BODY_PARTS = ("Cabeça", "Estômago", "Tornozelo", "Pele")
NURSES = ("Enf. Ana", "Enf. João", "Enf. Márcia")
PLACES = ("Piscina", "Restaurante", "Quarto")
SURVEY_STATUS = {"F": "Respondido", "O": "Em Aberto", "P": "Enviado"}
ROLES = ("Camareira", "Garçom", "Recepcionista")
LANG_MONTH = {"de": 1, "en": 2, "es": 3, "fr": 4}
INDICATORS = ("reclamacao", "nps", "gri", "receitaextra", "custodealimentos", "cmvdealimentos",
              "custodebebidas", "cmvdebebidas", "custodeaeb", "cmvaeb")


def _pick(values, index: Column) -> Column:
    """values[index] for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _case(col: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        lit = F.lit(v).cast("string")
        expr = F.when(col == k, lit) if expr is None else expr.when(col == k, lit)
    return expr


def _dec(col: str, p: str = "decimal(18,2)") -> Column:
    return F.col(col).cast(p)


class Bindings:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """The raw table, read once per binding set (a lazy plan: the file listing and footer
        are reused, the data is read by every query that runs)."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    # -- orders-based -----------------------------------------------------------------
    def _orders(self) -> DataFrame:
        o = self.raw("orders")
        ridx = F.substring("o_orderpriority", 1, 1).cast("int") - 1
        d = F.to_date("o_orderdate")
        return o.withColumns({"_ridx": ridx, "_d": d})

    def daily_occupancy(self) -> DataFrame:
        o = self._orders()
        from_orders = o.groupBy("_ridx", "_d").agg(
            F.count(F.lit(1)).alias("hosptotal"),
            F.count_if(F.col("o_orderstatus") == "F").alias("lazer"),
            F.count_if(F.col("o_orderstatus") == "O").alias("eventos"))
        # distinct guests per resort and day: first one row per (resort, day, user), then count;
        # two plain aggregates instead of three DISTINCT aggregates (which expand every row 3×)
        e = self.raw("events").withColumns({"_ridx": F.col("user_id") % 5, "_d": F.to_date("ts")})
        per_user = e.groupBy("_ridx", "_d", "user_id").agg(
            F.max(F.col("event_type").isin("view", "click").cast("int")).alias("_l"),
            F.max((F.col("event_type") == "purchase").cast("int")).alias("_e"))
        from_events = per_user.groupBy("_ridx", "_d").agg(
            F.count(F.lit(1)).alias("hosptotal"), F.sum("_l").alias("lazer"), F.sum("_e").alias("eventos"))
        both = from_orders.unionByName(from_events)
        resort = _pick(RESORT_LABELS, F.col("_ridx"))
        data = F.date_format("_d", "yyyy-MM-dd")
        return both.select(
            F.concat_ws(":", resort, data).alias("id"), resort.alias("resort"),
            _pick(COMPANIES, F.col("_ridx")).alias("empresa"), data.alias("data"), F.col("_d").alias("data__date"),
            F.col("hosptotal").cast("bigint").alias("hosptotal"), F.col("lazer").cast("bigint").alias("lazer"),
            F.col("eventos").cast("bigint").alias("eventos"),
            F.month("_d").cast("bigint").alias("mes"), F.year("_d").cast("bigint").alias("ano"),
            F.dayofmonth("_d").cast("bigint").alias("dia"))

    def accommodation_revenue(self) -> DataFrame:
        o = self._orders()
        g = o.groupBy("_ridx", F.year("_d").alias("ano"), F.month("_d").alias("mes")).agg(
            F.sum(F.when(F.col("o_orderstatus") == "F", _dec("o_totalprice"))).alias("lazer"),
            F.sum(F.when(F.col("o_orderstatus") == "O", _dec("o_totalprice"))).alias("eventos"))
        return g.select(
            _pick(RESORT_LABELS, F.col("_ridx")).alias("hotel"), F.col("ano").cast("bigint"),
            F.col("mes").cast("bigint"), F.col("lazer").cast("double"), F.col("eventos").cast("double"))

    def guest_targets(self) -> DataFrame:
        o = self._orders().withColumn("categoria", _case(F.col("o_orderstatus"), {"F": "Lazer", "O": "Eventos", "P": "Outros"}))
        g = o.groupBy("_ridx", F.year("_d").alias("ano"), F.month("_d").alias("mes"), "categoria").agg(
            F.count(F.lit(1)).alias("hospmeta"))
        g = g.where(~((F.col("categoria") == "Eventos") & (F.col("mes") == 2)))
        return g.select(_pick(RESORT_LABELS, F.col("_ridx")).alias("resort"), F.col("ano").cast("bigint"),
                        F.col("mes").cast("bigint"), "categoria", F.col("hospmeta").cast("bigint"))

    def employee_sentiment_surveys(self) -> DataFrame:
        o, c, n = self.raw("orders"), self.raw("customer"), self.raw("nation")
        j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        return j.select(
            F.col("o_orderkey").alias("id"), F.col("n_name").alias("hotel"),
            F.year("o_orderdate").cast("bigint").alias("ano"), F.month("o_orderdate").cast("bigint").alias("mes"),
            F.col("c_mktsegment").alias("cr"), F.col("c_name").alias("destinatario"),
            _pick(ROLES, F.col("c_custkey") % 3).alias("cargo"),
            F.concat(F.lit("Grupo "), F.col("c_mktsegment")).alias("grupos"),
            F.concat(F.lit("Líder "), F.initcap("c_mktsegment")).alias("lideres"),
            _case(F.col("o_orderstatus"), SURVEY_STATUS).alias("status"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("dataehora"),
            F.when(F.col("c_acctbal") > 5000, F.lit("Sim")).otherwise(F.lit("Não")).alias("egerente"))

    def employee_overtime_balance(self) -> DataFrame:
        o, c, n = self.raw("orders"), self.raw("customer"), self.raw("nation")
        g = o.groupBy("o_custkey", F.year("o_orderdate").alias("ano"), F.month("o_orderdate").alias("mes")).agg(
            (F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", _dec("o_totalprice"))), F.lit(0))
             - F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "O", _dec("o_totalprice"))), F.lit(0))).alias("_bal"))
        j = g.join(c, g.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        return j.select(
            F.concat_ws(":", F.col("o_custkey").cast("string"), F.col("ano").cast("string"),
                        F.col("mes").cast("string")).alias("id"),
            F.col("n_name").alias("hotel"), F.col("ano").cast("bigint"), F.col("mes").cast("bigint"),
            F.col("c_mktsegment").alias("cr"), F.col("c_name").alias("nome"),
            (F.col("_bal").cast("double") / 1000).alias("horas"))

    # -- lineitem-based ---------------------------------------------------------------
    def _lines(self) -> DataFrame:
        l, o = self.raw("lineitem"), self._orders()
        return l.join(o, l.l_orderkey == o.o_orderkey)

    def _category(self) -> Column:
        return (F.when(F.col("l_returnflag") == "R", F.lit("Outros"))
                .when(F.col("l_linestatus") == "F", F.lit("Lazer")).otherwise(F.lit("Eventos")))

    def extra_revenue(self) -> DataFrame:
        lp = self._lines().join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        data = F.date_format("_d", "yyyy-MM-dd")
        return lp.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
            _pick(RESORT_LABELS, F.col("_ridx")).alias("resort"),
            F.month("_d").cast("bigint").alias("mes"),
            F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("pdv"),
            self._category().alias("categoria"),
            F.year("_d").cast("bigint").alias("ano"), data.alias("data"), F.col("_d").alias("data__date"),
            F.col("l_quantity").cast("bigint").alias("hospedes"),
            F.col("l_extendedprice").alias("vendatotalpdv"),
            F.dayofmonth("_d").cast("bigint").alias("dia"))

    def monthly_extra_revenue_targets(self) -> DataFrame:
        g = self._lines().groupBy("_ridx", F.year("_d").alias("ano"), F.month("_d").alias("mes"),
                                  self._category().alias("categoria"), "l_linenumber").agg(
            (F.sum("l_quantity") / 100).alias("meta"))
        return g.select(_pick(RESORT_LABELS, F.col("_ridx")).alias("resort"), F.col("ano").cast("bigint"),
                        F.col("mes").cast("bigint"), "categoria", "meta")

    def pos_item_sales(self) -> DataFrame:
        lp = self._lines().join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        value = (_dec("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - _dec("l_discount", "decimal(4,2)")))
        return lp.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
            _pick(RESORT_LABELS, F.col("_ridx")).alias("hotel"),
            F.month("_d").cast("bigint").alias("mes"), F.dayofmonth("_d").cast("bigint").alias("dia"),
            self._category().alias("categoria"), F.col("p_brand").alias("pdv"), F.col("p_type").alias("classe"),
            F.col("p_name").alias("itemcomanda"), value.cast("decimal(18,4)").alias("valorcomanda"),
            F.col("l_quantity").cast("bigint").alias("qtdeitemcomanda"),
            F.year("_d").cast("bigint").alias("ano"))

    def business_indicators(self) -> DataFrame:
        lines = self._lines()
        price = _dec("l_extendedprice")
        measures = {
            "reclamacaoreal": F.count_if(F.col("l_returnflag") == "R"),
            "reclamacaometa": F.count_if(F.col("l_returnflag") == "A"),
            "npsreal": F.count_if(F.col("l_linestatus") == "F"),
            "npsmeta": F.count_if(F.col("l_linestatus") == "O"),
            "grireal": F.sum(F.col("l_quantity").cast("bigint")),
            "grimeta": F.count(F.lit(1)) * 25,
            "receitaextrareal": F.sum(price),
            "receitaextrameta": F.sum(F.when(F.col("o_orderstatus") == "F", price)),
            "custodealimentosreal": F.sum(price * _dec("l_discount", "decimal(4,2)")),
            "custodealimentosmeta": F.sum(price * _dec("l_tax", "decimal(4,2)")),
            "cmvdealimentosreal": F.sum(F.when(F.col("l_linenumber") == 1, price)),
            "cmvdealimentosmeta": F.sum(F.when(F.col("l_linenumber") == 2, price)),
            "custodebebidasreal": F.count_if(F.col("l_linenumber") % 2 == 0),
            "custodebebidasmeta": F.count_if(F.col("l_linenumber") % 2 == 1),
            "cmvdebebidasreal": F.sum(F.when(F.col("o_orderstatus") == "O", price)),
            "cmvdebebidasmeta": F.sum(F.when(F.col("o_orderstatus") == "P", price)),
            "custodeaebreal": F.count_if(F.col("l_linenumber") == 3),
            "custodeaebmeta": F.count_if(F.col("l_linenumber") == 4),
            "cmvaebreal": F.sum(F.when(F.col("l_returnflag") == "N", price)),
            "cmvaebmeta": F.sum(F.when(F.col("l_returnflag") == "A", price)),
        }
        monthly = lines.groupBy("_ridx", F.year("_d").alias("ano"), F.month("_d").alias("mes")).agg(
            *[v.alias(k) for k, v in measures.items()])
        # Half-year and annual periods re-sum the monthly rows (every measure is additive).
        re_agg = [F.sum(k).alias(k) for k in measures]
        half = F.when(F.col("mes") <= 6, F.lit("H1")).otherwise(F.lit("H2"))
        halves = monthly.groupBy("_ridx", "ano", half.alias("periodo")).agg(*re_agg)
        annual = monthly.groupBy("_ridx", "ano").agg(*re_agg).withColumn("periodo", F.lit("Annual"))
        months = monthly.withColumn("periodo", F.col("mes").cast("string")).drop("mes")
        allp = months.unionByName(halves).unionByName(annual)
        return allp.select(
            F.concat_ws(":", _pick(RESORT_LABELS, F.col("_ridx")), F.col("ano").cast("string"), F.col("periodo")).alias("id"),
            _pick(RESORT_LABELS, F.col("_ridx")).alias("hotel"), F.col("ano").cast("bigint"), "periodo",
            *[F.col(k).cast("double").alias(k) for k in measures])

    def overtime(self, flag: str, measure: str, dropped_type: str) -> DataFrame:
        l, s, n, p = self.raw("lineitem"), self.raw("supplier"), self.raw("nation"), self.raw("part")
        j = (l.where(F.col("l_returnflag") == flag).join(p, l.l_partkey == p.p_partkey)
             .where(F.col("p_type") != dropped_type)
             .join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey))
        cr = F.when(F.col("l_linenumber") % 2 == 0, F.col("p_type")).otherwise(F.concat(F.initcap("p_type"), F.lit(" ")))
        return j.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
            F.col("n_name").alias("hotel"), F.year("l_shipdate").cast("bigint").alias("ano"),
            F.month("l_shipdate").cast("bigint").alias("mes"), cr.alias("cr"), F.col("l_quantity").alias(measure))

    def overtime_positive(self) -> DataFrame:
        return self.overtime("A", "horaspositiva", "ECONOMY")

    def overtime_negative(self) -> DataFrame:
        return self.overtime("R", "horasnegativas", "PROMO")

    # -- events-based -----------------------------------------------------------------
    def _events(self) -> DataFrame:
        e = self.raw("events")
        return e.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))

    def guest_feedback(self) -> DataFrame:
        e = self._events()
        tipo = _case(F.col("event_type"), FEEDBACK_TYPES)
        kw = (F.when(F.col("_k") % 10 == 0, F.lit(None).cast("string")).when(F.col("_k") % 10 == 5, F.lit(""))
              .otherwise(F.concat(F.lit("Tema "), F.col("_k").cast("string"))))
        return e.select(
            F.col("event_id").alias("id"), _pick(RESORT_LABELS, F.col("user_id") % 5).alias("hotel"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datapreenchimento"),
            _pick(DEPARTMENTS, F.col("user_id") % 7).alias("cr"), kw.alias("palavrachave"),
            F.col("value").alias("nota"), tipo.alias("tipocomentario"),
            F.concat(tipo, F.lit(": "), F.col("event_type"), F.lit(" #"), F.col("event_id").cast("string")).alias("comentario"),
            _pick(BUILDINGS, F.col("event_id") % 3).alias("predio"),
            F.dayofmonth("ts").cast("bigint").alias("dia"), F.month("ts").cast("bigint").alias("mes"),
            F.year("ts").cast("bigint").alias("ano"))

    def medical_attendances(self) -> DataFrame:
        e = self._events()
        complaint = F.when(F.col("_k") % 7 == 0, F.lit(None).cast("string")).otherwise(_pick(COMPLAINTS, F.col("_k") % 5))
        return e.select(
            F.col("event_id").alias("id"),
            F.date_format("ts", "yyyy-MM-dd").alias("data"), F.date_format("ts", "HH:mm:ss").alias("horario"),
            _case(F.col("event_type"), PATIENT_TYPES).alias("hospedeouemocionador"),
            _pick(DEPARTMENTS, F.col("user_id") % 7).alias("cr"),
            F.concat(F.lit("Paciente "), F.col("user_id").cast("string")).alias("nomecompleto"),
            complaint.alias("ocorrenciaqueixa"),
            _pick(BODY_PARTS, F.col("_k") % 4).alias("partedocorpodosintoma"),
            F.when(F.col("value") > 300, F.lit("Sim")).otherwise(F.lit("Não")).alias("houvetransferenciaparaohospital"),
            _pick(NURSES, F.col("event_id") % 3).alias("enfermeiroaresponsavel"),
            _pick(PLACES, F.col("user_id") % 3).alias("localocorrencia"),
            _pick(RESORT_LABELS, F.col("user_id") % 5).alias("hotel"),
            F.dayofmonth("ts").cast("bigint").alias("dia"), F.month("ts").cast("bigint").alias("mes"),
            F.year("ts").cast("bigint").alias("ano"))

    # -- supplier / documents ---------------------------------------------------------
    def department_complaint_targets(self) -> DataFrame:
        s = self.raw("supplier")
        codes = RESORT_CODES + ("all_resorts",)
        return s.select(
            F.col("s_suppkey").alias("id"), _pick(codes, F.col("s_suppkey") % 6).alias("hotel"),
            (F.expr("s_suppkey div 6") % 3 + 1).cast("bigint").alias("mes"), F.lit(2024).cast("bigint").alias("ano"),
            _pick(DEPARTMENTS, F.col("s_suppkey") % 7).alias("cr"), (F.col("s_acctbal") / 1000).alias("meta"))

    def _labelled_docs(self) -> DataFrame:
        d, lab = self.raw("documents"), self.raw("labels")
        return d.join(lab, "doc_id").withColumn("_mes", _case(F.col("lang"), LANG_MONTH).cast("bigint"))

    def employee_sentiment_by_resort(self) -> DataFrame:
        g = self._labelled_docs().groupBy("source", "_mes").agg(
            F.avg("quality").alias("taxageraldeadesao"), (1 - F.avg("toxic")).alias("score"),
            F.count(F.lit(1)).cast("string").alias("notas"))
        return g.select(
            F.concat_ws(":", "source", F.col("_mes").cast("string")).alias("id"),
            F.col("source").alias("hotel"), F.lit(2024).cast("bigint").alias("ano"), F.col("_mes").alias("mes"),
            F.lit("Geral").alias("dimensaonova"), "taxageraldeadesao", "score",
            F.when(F.col("score") >= 0.9, F.lit("Bom")).otherwise(F.lit("Atenção")).alias("scorehotelsituacao"),
            "notas")

    def employee_sentiment_by_department(self) -> DataFrame:
        docs = self._labelled_docs().withColumn("cr", _pick(DEPARTMENTS, F.col("doc_id") % 7))
        g = docs.groupBy("source", "_mes", "cr").agg(
            F.avg("quality").alias("taxageraldeadesao"), (1 - F.avg("toxic")).alias("score"),
            F.count(F.lit(1)).cast("string").alias("notas"))
        return g.select(
            F.concat_ws(":", "source", F.col("_mes").cast("string"), "cr").alias("id"),
            F.col("source").alias("hotel"), F.lit(2024).cast("bigint").alias("ano"), F.col("_mes").alias("mes"),
            F.lit("Geral").alias("dimensaonova"), "taxageraldeadesao", "score",
            F.when(F.col("score") >= 0.9, F.lit("Bom")).otherwise(F.lit("Atenção")).alias("scorehotelsituacao"),
            "notas", F.concat(F.lit("Líder "), F.col("cr")).alias("lideresdiretos"), "cr",
            F.lit("Operacional").alias("nivel"), F.lit("Direta").alias("lideranca"))


_CATALOGS: dict[tuple, Catalog] = {}


def testdata_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Catalog whose tables are the bindings above over ``sf_dir`` (one per session and folder,
    so the lazy binding plans are built once and shared by every query)."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CATALOGS:
        _CATALOGS[key] = _new_catalog(spark, sf_dir)
    return _CATALOGS[key]


def _new_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    b = Bindings(spark, sf_dir)
    names = ("daily_occupancy", "guest_feedback", "department_complaint_targets", "business_indicators",
             "extra_revenue", "accommodation_revenue", "monthly_extra_revenue_targets", "guest_targets",
             "pos_item_sales", "medical_attendances", "overtime_positive", "overtime_negative",
             "employee_overtime_balance", "employee_sentiment_by_resort", "employee_sentiment_by_department",
             "employee_sentiment_surveys")
    return Catalog(spark, {n: getattr(b, n) for n in names})


# --- raw string sheets for the ingest operators -----------------------------------------------
# A spreadsheet export as the ingest job receives it: every cell text, a dirty header, decimal
# commas, padded text, a tab inside some cells and fully blank lines; line 0 is the header.
CUSTOMER_SHEET_HEADER = (" Código ", "Nome", "País", "Saldo (R$)", "Segmento", "NOME")
CUSTOMER_SHEET_SOURCE, CUSTOMER_SHEET_TAB = "testdata-customers", "Clientes"


def customer_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as a raw sheet (``_c0``…``_c5``, ``_file``, ``_pos``): every customer is one
    line, in key order, and after every 97 customers the export holds one fully blank line. The
    position is closed-form (key + 1 + blank lines before it), so no ordering job is needed."""
    c = spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet")
    key = F.col("c_custkey")
    pos = key + 1 + F.expr("c_custkey div 97")
    lines = c.select(
        key.cast("string").alias("_c0"),
        F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("_c1"),
        F.col("c_nationkey").cast("string").alias("_c2"),
        F.replace(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")).alias("_c3"),
        F.when(key % 13 == 0, F.concat(F.col("c_mktsegment"), F.lit("\textra")))
        .otherwise(F.col("c_mktsegment")).alias("_c4"),
        F.lower("c_name").alias("_c5"),
        F.lit("customer.parquet").alias("_file"), pos.alias("_pos"))
    blank = c.where(key % 97 == 96).select(
        *[F.lit("").alias(f"_c{i}") for i in range(6)], F.lit("customer.parquet").alias("_file"),
        (pos + 1).alias("_pos"))
    return lines.unionByName(blank)


def lineitem_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with every column rendered as text the way sheets hold it (for inference)."""
    l = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    return l.select(
        F.col("l_orderkey").cast("string").alias("pedido"),
        F.col("l_quantity").cast("bigint").cast("string").alias("quantidade"),
        F.replace(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")).alias("preco"),
        F.col("l_discount").cast("decimal(4,2)").cast("string").alias("desconto"),
        F.col("l_returnflag").alias("flag"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("envio"),
        F.when(F.col("l_linenumber") == 1, F.lit(" ")).otherwise(F.col("l_linenumber").cast("string")).alias("linha"),
        F.lit("").alias("vazia"),
        F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(F.lit("1")).alias("misto"))

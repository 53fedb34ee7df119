"""The 194 sources of the live extract and their previous-generation keys."""

from __future__ import annotations

from dataclasses import dataclass

# View, tier, counted rows (`?` = never counted), business key columns; in
# extractor order 1, 2, 3 and load order within each.
ERP = """
MDMA   1          0 MANDT MATNR BERID
T134   1         40 MANDT MTART
T001W  1        336 MANDT WERKS
T001   1        430 MANDT BUKRS
T023   1        769 MANDT MATKL
T024I  1       1963 MANDT IWERK INGRP
CRCA   1       5638 MANDT OBJTY OBJID CANUM
TJ30T  1       7213 MANDT STSMA ESTAT SPRAS
T024D  1       9285 MANDT WERKS DISPO
IFLOT  1      20068 MANDT TPLNR
CRCO   1      28134 MANDT OBJTY OBJID LASET ENDDA LANUM
MSKU   1      49694 MANDT MATNR WERKS CHARG SOBKZ KUNNR
T156T  1      58621 MANDT SPRAS BWART SOBKZ KZBEW KZZUG KZVBR
MPOS   1     115255 MANDT WARPL WAPOS
PLFL   1     261515 MANDT PLNTY PLNNR PLNAL PLNFL ZAEHL
KNVK   1     312248 MANDT PARNR
QMUR   1     707389 MANDT QMNUM FENUM URNUM
EAPL   ?          ? MANDT EQUNR PLNTY PLNNR PLNAL ZKRIZ ZAEHL
IMPTT  ?          ? MANDT POINT
KAKT   ?          ? MANDT KAPID SPRAS
RKPF   ?          ? MANDT RSNUM
T353I  ?          ? MANDT ILART
T370F  ?          ? MANDT FLTYP
T430T  ?          ? MANDT SPRAS PLNAW STEUS
PLMZ   2    1106480 MANDT PLNTY PLNNR ZUONR ZAEHL
MARA   2    1254124 MANDT MATNR
MARM   2    1399952 MANDT MATNR MEINH
KNVV   2    1487203 MANDT KUNNR VKORG VTWEG SPART
MAKT   2    1707991 MANDT MATNR SPRAS
QMEL   2    1989965 MANDT QMNUM
MARC   2    2331034 MANDT MATNR WERKS
EQUZ   2    2766450 MANDT EQUNR DATBI EQLFN
MAPL   2    3396230 MANDT MATNR WERKS PLNTY PLNNR PLNAL ZAEHL
EKKO   2    5377290 MANDT EBELN
OBJK   2    8800815 MANDT OBKNR OBZAE
QAVE   3   11083415 MANDANT PRUEFLOS KZART ZAEHLER
PMCO   3   12346036 MANDT OBJNR COCUR BELTP WRTTP GJAHR ACPOS VERSN PERBL VORGA BEMOT ABKAT
MCHB   3   13975831 MANDT MATNR WERKS LGORT CHARG
AUFK   3   14446636 MANDT AUFNR
VTTK   3   17116336 MANDT TKNUM
LIKP   3   25404608 MANDT VBELN
VBBE   3   33057061 MANDT VBELN POSNR ETENR
KSSK   3   46527246 MANDT OBJEK MAFID KLART ADZHL
AFVC   3   72700785 MANDT AUFPL APLZL
VBEP   4  112112436 MANDT VBELN POSNR ETENR
VBPA   4  263924069 MANDT VBELN POSNR PARVW
AUFM   4  350809194 MANDT MBLNR MJAHR ZEILE
COSP   4  706716382 MANDT LEDNR OBJNR GJAHR WRTTP VERSN KSTAR HRKFT VRGNG VBUND PARGB BEKNZ TWAER PERBL
MDTB   5 5379495282 MANDT DTNUM DTPOS
TVSB   1         18 MANDT VSBED
TQ80   1         60 MANDT QMART
T001K  1        339 MANDT BWKEY
T006   1        484 MANDT MSEHI
T024   1       1189 MANDT EKGRP
QPGR   1       3121 MANDT KATALOGART CODEGRUPPE
KAKO   1       5642 MANDT KAPID
CRTX   1       8096 MANDT OBJTY OBJID SPRAS
KAZY   1      10685 MANDT KAPID VERSN DATUB
IFLOTX 1      21893 MANDT TPLNR SPRAS
MPLA   1      29496 MANDT WARPL
SER05  1      55035 MANDT OBKNR
CSKT   1      82026 MANDT SPRAS KOKRS KOSTL DATBI
PLWP   1     117194 MANDT PLNTY PLNNR PLNAL PLNFL PLNKN PAKET ZAEHL
MKAL   1     281885 MANDT MATNR WERKS VERID
QPCT   1     474681 MANDT KATALOGART CODEGRUPPE CODE SPRACHE VERSION
MAST   1     781214 MANDT MATNR WERKS STLAN STLNR STLAL
AFRC   ?          ? MANDT AUFNR RUECK RMZHL
IFLOS  ?          ? MANDT TPLNR ALKEY VERSN
T156HT ?          ? MANDT SPRAS BWART
T301   ?          ? MANDT LGNUM LGTYP
T357   ?          ? MANDT WERKS BEBER
T370T  ?          ? MANDT EQTYP
T430   ?          ? MANDT PLNAW STEUS
TC25T  ?          ? MANDT SPRAS IDENT
AFFW   2    1125556 MANDT WEBLNR WEBLPOS
STKO   2    1359773 MANDT STLTY STLNR STLAL STKOZ
KNA1   2    1408544 MANDT KUNNR
SER03  2    1543771 MANDT OBKNR
QMAT   2    1954680 MANDT ART MATNR WERKS
EINE   2    2159624 MANDT INFNR EKORG ESOKZ WERKS
MDKP   2    2502142 MANDT DTNUM
PLAS   2    2767802 MANDT PLNTY PLNNR PLNKN ZAEHL
MHIO   2    5186856 MANDT WARPL ABNUM WPPOS
AFPO   2    6335594 MANDT AUFNR POSNR
MCH1   2    9263775 MANDT MATNR CHARG
ILOA   3   11207563 MANDT ILOAN
AFKO   3   12749465 MANDT AUFNR
VBAK   3   14299699 MANDT VBELN
STPO   3   15348670 MANDT STLTY STLNR STLKN STPOZ
MARD   3   17166926 MANDT MATNR WERKS LGORT
STAS   3   27362006 MANDT STLTY STLNR STLAL STLKN STASZ
EKBE   3   43813684 MANDT EBELN EBELP ZEKKN VGABE GJAHR BELNR BUZEI
KEKO   3   58881095 MANDT BZOBJ KALNR KALKA KADKY TVERS BWVAR KKZMA
AFVV   3   72707752 MANDT AUFPL APLZL
AFRU   4  144430339 MANDT RUECK RMZHL
MKPF   4  292610764 MANDT MBLNR MJAHR
MSEG   4  490375041 MANDT MBLNR MJAHR ZEILE
RESB   4  843543737 MANDT RSNUM RSPOS RSART
COEP   5 2949490993 MANDT KOKRS BELNR BUZEI
TPST   1         39 MANDT TPLNR WERKS STLAN STLNR STLAL
T024E  1         62 MANDT EKORG
T156   1        349 MANDT BWART
T134T  1        765 MANDT SPRAS MTART
T003P  1       1882 CLIENT SPRAS AUART
T001L  1       4168 MANDT WERKS LGORT
CRHD   1       6264 MANDT OBJTY OBJID BEGDA ENDDA
T006A  1       8969 MANDT SPRAS MSEHI
T023T  1      11105 MANDT SPRAS MATKL
EQST   1      28027 MANDT EQUNR WERKS STLAN STLNR STLAL
QPGT   1      35263 MANDANT KATALOGART CODEGRUPPE SPRACHE
CSKS   1      57411 MANDT KOKRS KOSTL DATBI
KAPA   1      82672 MANDT KAPID VERSN DATUB TAGNR SCHNR
LFA1   1     129916 MANDT LIFNR
PLKO   1     304392 MANDT PLNTY PLNNR PLNAL
SER01  1     535535 MANDT OBKNR
QMFE   1     940696 MANDT QMNUM FENUM
IMRG   ?          ? MANDT MDOCM
LAGP   ?          ? MANDT LGNUM LGTYP LGPLA
T356   ?          ? MANDT ARTPR PRIOK
T370S  ?          ? MANDT TPLKZ
TAPL   ?          ? MANDT TPLNR PLNTY PLNNR PLNAL ZKRIZ ZAEHL
TC25   ?          ? MANDT IDENT
TC37A  ?          ? MANDT SCHGRUP KAPTPROG ENDDA
TVEPZ  ?          ? MANDT PSTYV DISMM
EINA   2    1128342 MANDT INFNR
EQKT   2    1397294 MANDT EQUNR SPRAS
EQUI   2    1434080 MANDT EQUNR
MHIS   2    1622661 MANDT WARPL ABNUM ZAEHL
QMIH   2    1989965 MANDT QMNUM
MBEW   2    2282427 MANDT MATNR BWKEY BWTAR
PLPO   2    2552329 MANDT PLNTY PLNNR PLNKN
QMSM   2    3158949 MANDT QMNUM MANUM
EKKN   2    5257736 MANDT EBELN EBELP ZEKKN
AFIH   2    6415666 MANDT AUFNR
LQUA   2    9567436 MANDT LQNUM
QALS   3   11274432 MANDANT PRUEFLOS
MCHA   3   13083956 MANDT MATNR WERKS CHARG
EKPO   3   14321553 MANDT EBELN EBELP
EKET   3   16500379 MANDT EBELN EBELP ETENR
VTTP   3   22340431 MANDT TKNUM TPNUM
AFWI   3   31390016 MANDT RUECK RMZHL MBLNR MJAHR MBLPO
QAMR   3   46452589 MANDANT PRUEFLOS VORGLFNR MERKNR
VBAP   3   70287949 MANDT VBELN POSNR
LIPS   3   85426484 MANDT VBELN POSNR
CKIS   4  200518975 MANDT LEDNR BZOBJ KALNR KALKA KADKY TVERS BWVAR KKZMA POSNR
AUSP   4  327379157 MANDT OBJEK ATINN ATZHL MAFID KLART ADZHL
VBFA   4  677404018 MANDT VBELV POSNV VBELN POSNN VBTYP_N
JEST   4  848522773 MANDT OBJNR STAT
EBAN   5 1735085875 MANDT BANFN BNFPO
"""

# View, business key columns; in load order.
LEDGER_IN = """
F40306 SRAN8 SRCS06 SRITM SRIT06 SREXDJ SRUOM SRMXQ SROSEQ
F30026 IEITM IEMMCU IELOCN IELOTN IELEDG IECOST
F0010  CCCO
F3003  IRMMCU IRKIT IRTRT IRBQTY IROPSQ IROPSC IRLINE IREFFF
F40072 GIITM GIPRFR
F41002 UMITM UMRUM UMUM
F4201  SHDOCO SHDCTO SHKCOO SHSFXO
F3002  IXKIT IXMMCU IXTBM IXBQTY IXCPNB IXSBNT IXCOBY
F4108  IOLOTN IOITM IOMCU
F4211  SDDOCO SDDCTO SDKCOO SDLNID
F4102  IBITM IBMCU
F03012 AIAN8 AICO
F4301  PHDOCO PHDCTO PHKCOO PHSFXO
F42119 SDDOCO SDDCTO SDKCOO SDLNID
F4111  ILUKID
"""

# View, business key columns; in load order.
LEDGER_NA = """
F30026 IEITM IEMMCU IELOCN IELOTN IELEDG IECOST
F0010  CCCO
F3003  IRMMCU IRKIT IRTRT IRBQTY IROPSQ IROPSC IRLINE IREFFF
F40072 GIITM GIPRFR
F41002 UMITM UMCUOM UMUM
F4201  SHDOCO SHDCTO SHKCOO SHSFXO
F3002  IXKIT IXMMCU IXTBM IXBQTY IXCPNB IXSBNT IXCOBY
F0006  MCMCU
F0101  ABAN8
F0911  GLDCT GLDOC GLKCO GLDGJ GLJELN GLLT GLEXTL
F30008 IWMMCU IWMCU IWLEDG
F3111  WMUKID
F3112  WLDOCO WLOPSQ WLOPSC WLMCU
F3411  MMUKID
F4101  IMITM
F41021 LIITM LIMCU LILOCN LILOTN
F4105  COITM COMCU COLOCN COLOTN COLEDG
F4108  IOLOTN IOITM IOMCU
F42019 SHDOCO SHDCTO SHKCOO
F43092 PXDOCO PXDCTO PXKCOO PXSFXO PXLNID PXNLIN PXUOM PXOPRS
F4311  PDDOCO PDDCTO PDKCOO PDLNID
F43121 PRMATC PRDOCO PRDCTO PRKCOO PRSFXO PRLNID PRNLIN PRDOC
F43199 OLUKID
F4801  WADOCO
F4211  SDDOCO SDDCTO SDKCOO SDLNID
F4102  IBITM IBMCU
F03012 AIAN8 AICO
F4301  PHDOCO PHDCTO PHKCOO PHSFXO
F42119 SLDOCO SLDCTO SLKCOO SLLNID
F4111  ILUKID
"""

# Never-counted views in the order they are dealt to the extractors.
UNCOUNTED = """
TC25 TC25T KAKT TC37A IFLOS IMPTT IMRG AFRC EAPL TAPL T430 T430T LAGP T301 RKPF TVEPZ T156HT T353I T356
T357 T370F T370S T370T
"""


@dataclass(frozen=True)
class Source:
    domain: str
    view: str
    tier: str
    rows: int | None
    key_columns: tuple[str, ...]

    @property
    def load(self) -> str:
        """How the previous generation loaded it: small tiers in full, the next by text window."""
        return {"1": "full", "2": "text"}.get(self.tier, "timestamp")

    @property
    def sampled(self) -> bool:
        """Whether the previous generation cut its timestamp window to a sample."""
        return self.load == "timestamp" and self.domain != "ledger_in"

    @property
    def query_name(self) -> str:
        return f"extract-{self.domain}-{self.view}"


def sources(domain: str) -> list[Source]:
    """Sources of `erp`, `ledger_in` or `ledger_na`."""
    if domain == "erp":
        rows = [line.split() for line in ERP.strip().splitlines()]
        return [Source(domain, v, t, None if n == "?" else int(n), tuple(k)) for v, t, n, *k in rows]
    text = {"ledger_in": LEDGER_IN, "ledger_na": LEDGER_NA}[domain]
    rows = [line.split() for line in text.strip().splitlines()]
    return [Source(domain, v, "-", None, tuple(k)) for v, *k in rows]


def catalogue() -> list[Source]:
    return [s for domain in ("erp", "ledger_in", "ledger_na") for s in sources(domain)]


def split_place(source: Source) -> int:
    """Place of a source among equals in the split: never-counted ones as dealt, others as listed."""
    if source.rows is None:
        return UNCOUNTED.split().index(source.view)
    return [s.view for s in sources(source.domain)].index(source.view)

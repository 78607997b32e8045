"""Declarative layouts of publication, patent and trial documents for xmlrows.shred.

Each layout is a schema for the nested document and the tables that come from it. A caller reads with read_xml (row tag and
schema) or parse_xml, and shreds all tables or some of them by name. Element names are those of the deliveries.
"""

from __future__ import annotations

from citeloom.sources.xmlrows import TableSpec

_ID = "struct<_idtype:string,_VALUE:string>"

_DATE = "struct<_year:int,_month:int,_day:int>"

PUBLICATION_TAG = "item"
PUBLICATION_SCHEMA = f"""
bibrecord struct<
 `item-info`:struct<itemidlist:struct<itemid:array<{_ID}>,`ce:doi`:string,`ce:pii`:string>>,
 head:struct<
  source:struct<_srcid:string,_type:string,sourcetitle:string,codencode:string,issn:array<struct<_type:string,_VALUE:string>>,isbn:array<struct<_type:string,_length:int,_level:string,_VALUE:string>>,
   publisher:array<struct<publishername:string,`ce:e-address`:string>>,publicationyear:struct<_first:int>,publicationdate:struct<year:int,month:int,day:int>,
   volisspag:struct<voliss:struct<_volume:string,_issue:string>,pagerange:struct<_first:string,_last:string>>,
   `additional-srcinfo`:struct<conferenceinfo:struct<
    confevent:struct<confcode:string,confname:string,conflocation:struct<`address-part`:string,city:string,`postal-code`:string>,confdate:struct<startdate:{_DATE},enddate:{_DATE}>,confnumber:string,confcatnumber:string,confsponsors:struct<confsponsor:array<string>>>,
    confpublication:struct<procpartno:string,procpagerange:string,procpagecount:string,confeditors:struct<editors:struct<editor:array<struct<`ce:indexed-name`:string,`ce:surname`:string,`ce:given-name`:string,`ce:degrees`:string>>>,editoraddress:array<string>,editororganization:array<string>>>>>>,
  correspondence:array<struct<affiliation:struct<organization:array<string>>>>,
  `citation-info`:struct<`citation-type`:struct<_code:string>,`citation-language`:array<struct<_language:string>>,`author-keywords`:struct<`author-keyword`:array<string>>>,
  `citation-title`:struct<titletext:array<struct<_language:string,_VALUE:string>>>,
  abstracts:struct<abstract:array<struct<`_xml:lang`:string,`ce:para`:array<string>>>>,
  `author-group`:array<struct<
   author:array<struct<_seq:int,_auid:long,`ce:indexed-name`:string,`ce:surname`:string,`ce:given-name`:string,`ce:initials`:string,`ce:e-address`:string>>,
   affiliation:struct<_afid:long,_dptid:long,_country:string,organization:array<string>,city:string,state:string,`postal-code`:string,country:string>>>,
  grantlist:struct<grant:array<struct<`grant-id`:string,`grant-acronym`:string,`grant-agency`:struct<`_iso-code`:string,_VALUE:string>,`grant-agency-id`:string>>,`grant-text`:string>,
  enhancement:struct<descriptorgroup:struct<descriptors:array<struct<descriptor:array<struct<mainterm:string>>>>>,
   classificationgroup:struct<classifications:array<struct<_type:string,classification:array<string>>>>,
   chemicalgroup:struct<chemicals:array<struct<_source:string,chemical:array<struct<`chemical-name`:string,`cas-registry-number`:array<string>>>>>>>>,
 tail:struct<bibliography:struct<reference:array<struct<_id:string,`ref-fulltext`:string,`ref-info`:struct<`refd-itemidlist`:struct<itemid:array<{_ID}>>,`ref-text`:string>>>>>>
"""


def _item(kind: str, at: str = "bibrecord.`item-info`.itemidlist.itemid") -> str:
    """The identifier of a kind as a whole number."""
    return f"try_cast(get(filter({at}, x -> x._idtype = '{kind}'), 0)._VALUE AS BIGINT)"


_SCP, _HEAD = _item("SCP"), "bibrecord.head"
_SOURCE = f"{_HEAD}.source"
_CONF, _PROC = f"{_SOURCE}.`additional-srcinfo`.conferenceinfo.confevent", f"{_SOURCE}.`additional-srcinfo`.conferenceinfo.confpublication"
_CONF_KEY = {"conf_code": f"coalesce({_CONF}.confcode, '')", "conf_name": f"coalesce(trim(regexp_replace({_CONF}.confname, '\\\\s+', ' ')), '')"}
_CLASSES = "bibrecord.head.enhancement.classificationgroup.classifications/classification"


def _date(of: str, year: str = "_year", month: str = "_month", day: str = "_day") -> str:
    """A date of which month and day may be missing; null if it is none."""
    return f"try_to_date(concat_ws('-', lpad({of}.{year}, 4, '0'), lpad(coalesce({of}.{month}, 1), 2, '0'), lpad(coalesce({of}.{day}, 1), 2, '0')), 'yyyy-MM-dd')"


_CLASS = "CASE WHEN r RLIKE '[0-9];' THEN left(r, 4) ELSE r END"

PUBLICATION_TABLES = {
    "publications": TableSpec("", {"scp": _SCP, "sgr": _item("SGR"), "pub_year": f"{_HEAD}.source.publicationyear._first", "citation_type": f"{_HEAD}.`citation-info`.`citation-type`._code", "citation_language": f"array_join({_HEAD}.`citation-info`.`citation-language`._language, ',')", "source_id": f"{_HEAD}.source._srcid"}, ("scp",)),
    "sources": TableSpec("", {"source_id": f"{_HEAD}.source._srcid", "source_type": f"{_HEAD}.source._type", "source_title": f"{_HEAD}.source.sourcetitle", "issn_main": f"get({_HEAD}.source.issn, 0)._VALUE", "isbn_main": f"get({_HEAD}.source.isbn, 0)._VALUE", "coden_code": f"{_SOURCE}.codencode", "publisher_name": f"get({_SOURCE}.publisher, 0).publishername", "publisher_e_address": f"get({_SOURCE}.publisher, 0).`ce:e-address`"}, ("source_id",)),
    "publication_groups": TableSpec("", {"sgr": _item("SGR"), "pub_year": f"{_SOURCE}.publicationyear._first"}, ("sgr",)),
    "isbns": TableSpec(f"{_SOURCE}.isbn", {"source_id": f"{_SOURCE}._srcid", "isbn": "r._VALUE", "isbn_length": "r._length", "isbn_type": "r._type", "isbn_level": "r._level"}, ("source_id", "isbn")),
    "issns": TableSpec(f"{_SOURCE}.issn", {"source_id": f"{_SOURCE}._srcid", "issn": "r._VALUE", "issn_type": "coalesce(r._type, '')"}, ("source_id", "issn", "issn_type")),
    "publication_details": TableSpec("", {"scp": _SCP, "issue": f"{_SOURCE}.volisspag.voliss._issue", "volume": f"{_SOURCE}.volisspag.voliss._volume", "first_page": f"{_SOURCE}.volisspag.pagerange._first", "last_page": f"{_SOURCE}.volisspag.pagerange._last", "publication_year": f"{_SOURCE}.publicationyear._first", "publication_date": f"CASE WHEN {_SOURCE}.publicationdate.year IS NOT NULL THEN {_date(_SOURCE + '.publicationdate', 'year', 'month', 'day')} END", **_CONF_KEY}, ("scp",)),
    "corresponding_organizations": TableSpec(f"{_HEAD}.correspondence", {"scp": _SCP, "organization": "array_join(r.affiliation.organization, ', ')"}, ("scp", "organization")),
    "indexed_terms": TableSpec("bibrecord.head.enhancement.descriptorgroup.descriptors/descriptor", {"scp": _SCP, "indexed_term": "trim(regexp_replace(r.mainterm, '\\\\s+', ' '))"}, ("scp", "indexed_term")),
    "subjects": TableSpec(_CLASSES, {"scp": _SCP, "subj_abbr": "r"}, ("scp", "subj_abbr"), where="up._type = 'SUBJABBR'"),
    "subject_keywords": TableSpec(_CLASSES, {"scp": _SCP, "subject": "r"}, ("scp", "subject"), where="up._type = 'SUBJECT'"),
    "conference_events": TableSpec("", _CONF_KEY | {"conf_address": f"{_CONF}.conflocation.`address-part`", "conf_city": f"{_CONF}.conflocation.city", "conf_postal_code": f"{_CONF}.conflocation.`postal-code`", "conf_start_date": f"CASE WHEN {_CONF}.confdate.startdate._year IS NOT NULL THEN {_date(_CONF + '.confdate.startdate')} END", "conf_end_date": f"CASE WHEN {_CONF}.confdate.enddate._year IS NOT NULL THEN {_date(_CONF + '.confdate.enddate')} END", "conf_number": f"{_CONF}.confnumber", "conf_catalog_number": f"{_CONF}.confcatnumber", "conf_sponsor": f"array_join({_CONF}.confsponsors.confsponsor, ',')"}, ("conf_code", "conf_name"), where=f"{_CONF} IS NOT NULL"),
    "conference_proceedings": TableSpec("", {"source_id": f"{_SOURCE}._srcid", **_CONF_KEY, "proc_part_no": f"{_PROC}.procpartno", "proc_page_range": f"{_PROC}.procpagerange", "proc_page_count": f"try_cast(regexp_replace({_PROC}.procpagecount, 'p[.]?$', '') AS SMALLINT)"}, ("source_id", "conf_code", "conf_name"), where=f"coalesce({_PROC}.procpartno, {_PROC}.procpagerange, {_PROC}.procpagecount) IS NOT NULL"),
    "conference_editors": TableSpec(f"{_PROC}.confeditors.editors.editor", {"source_id": f"{_SOURCE}._srcid", **_CONF_KEY, "indexed_name": "coalesce(r.`ce:indexed-name`, '')", "surname": "r.`ce:surname`", "given_name": "r.`ce:given-name`", "degree": "r.`ce:degrees`", "address": f"array_join({_PROC}.confeditors.editoraddress, ',')", "organization": f"array_join({_PROC}.confeditors.editororganization, ',')"}, ("source_id", "conf_code", "conf_name", "indexed_name")),
    "author_affiliations": TableSpec("bibrecord.head.`author-group`/author", {"scp": _SCP, "affiliation_no": "up_pos", "author_seq": "r._seq"}, ("scp", "affiliation_no", "author_seq"), where="up.affiliation IS NOT NULL"),
    "authors": TableSpec("bibrecord.head.`author-group`/author", {"scp": _SCP, "author_seq": "r._seq", "auid": "r._auid", "indexed_name": "r.`ce:indexed-name`", "surname": "r.`ce:surname`", "given_name": "r.`ce:given-name`", "initials": "r.`ce:initials`", "e_address": "r.`ce:e-address`"}, ("scp", "author_seq")),
    "affiliations": TableSpec("bibrecord.head.`author-group`", {"scp": _SCP, "affiliation_no": "pos", "afid": "r.affiliation._afid", "dptid": "r.affiliation._dptid", "organization": "array_join(r.affiliation.organization, ', ')", "city": "r.affiliation.city", "state": "r.affiliation.state", "postal_code": "r.affiliation.`postal-code`", "country_code": "r.affiliation._country", "country": "r.affiliation.country"}, ("scp", "affiliation_no")),
    "abstracts": TableSpec("bibrecord.head.abstracts.abstract", {"scp": _SCP, "language": "coalesce(r.`_xml:lang`, '')", "abstract": "array_join(r.`ce:para`, '\n')"}, ("scp", "language")),
    "titles": TableSpec("bibrecord.head.`citation-title`.titletext", {"scp": _SCP, "language": "coalesce(r._language, '')", "title": "trim(regexp_replace(r._VALUE, '\\\\s+', ' '))"}, ("scp", "language")),
    "keywords": TableSpec("bibrecord.head.`citation-info`.`author-keywords`.`author-keyword`", {"scp": _SCP, "keyword": "r"}, ("scp", "keyword")),
    "identifiers": TableSpec("bibrecord.`item-info`.itemidlist.itemid", {"scp": _SCP, "document_id": "r._VALUE", "document_id_type": "upper(r._idtype)"}, ("scp", "document_id", "document_id_type")),
    "dois": TableSpec("", {"scp": _SCP, "document_id": "bibrecord.`item-info`.itemidlist.`ce:doi`", "document_id_type": "'DOI'"}, ("scp", "document_id", "document_id_type")),
    "piis": TableSpec("", {"scp": _SCP, "document_id": "bibrecord.`item-info`.itemidlist.`ce:pii`", "document_id_type": "'PII'"}, ("scp", "document_id", "document_id_type")),
    "grants": TableSpec("bibrecord.head.grantlist.grant", {"scp": _SCP, "grant_id": "coalesce(r.`grant-id`, '')", "grantor": "r.`grant-agency`._VALUE", "grantor_acronym": "r.`grant-acronym`", "country_code": "r.`grant-agency`.`_iso-code`", "registry_id": "r.`grant-agency-id`"}, ("scp", "grant_id", "grantor")),
    "acknowledgments": TableSpec("", {"scp": _SCP, "grant_text": f"{_HEAD}.grantlist.`grant-text`"}, ("scp",), where=f"{_HEAD}.grantlist.`grant-text` IS NOT NULL"),
    "classes": TableSpec("bibrecord.head.enhancement.classificationgroup.classifications/classification", {"scp": _SCP, "class_type": "coalesce(up._type, '')", "class_code": f"CASE WHEN length({_CLASS}) = 4 THEN {_CLASS} END"}, ("scp", "class_type", "class_code"), where="coalesce(up._type, '') NOT IN ('SUBJABBR', 'SUBJECT')"),
    "chemicals": TableSpec("bibrecord.head.enhancement.chemicalgroup.chemicals/chemical", {"scp": _SCP, "chemical_name": "r.`chemical-name`", "registry_number": "coalesce(array_join(r.`cas-registry-number`, ';'), '')"}, ("scp", "chemical_name", "registry_number")),
    "references": TableSpec("bibrecord.tail.bibliography.reference", {"scp": _SCP, "ref_sgr": _item("SGR", "r.`ref-info`.`refd-itemidlist`.itemid"), "citation_text": "coalesce(r.`ref-fulltext`, r.`ref-info`.`ref-text`)"}, ("scp", "ref_sgr"), where=f"NOT ({_item('SGR', 'r.`ref-info`.`refd-itemidlist`.itemid')} <=> {_SCP})"),
}

_DOC = "country:string,`doc-number`:string,kind:string,date:string,name:string"
_BOOK = "array<struct<_lang:string,name:string,orgname:string,`last-name`:string,`first-name`:string,address:struct<`address-1`:string,street:string,city:string,state:string,postcode:string,country:string>>>"
_PARTY = f"array<struct<_sequence:int,`_data-format`:string,addressbook:{_BOOK}>>"

# The elements of a legal event beside its sequence and date.
LEGAL = (
    "event-code-1 event-code-2 effect legal-description status-identifier docdb-publication-number docdb-application-id designated-state-authority designated-state-event-code designated-state-description "
    "corresponding-publication-number corresponding-authority corresponding-publication-date corresponding-kind legal-designated-states extension-state-authority new-owner free-text-description spc-number filing-date "
    "expiry-date inventor-name ipc representative-name payment-date opponent-name fee-payment-year requester-name countries-concerned effective-date withdrawn-date"
).split()
# The kinds of related documents that name a parent and a child.
RELATED = "addition division continuation continuation-in-part continuing-reissue reissue divisional-reissue reexamination reexamination-reissue-merger substitution utility-model-basis a-371-of-international".split()
_LEGAL_FIELDS = ",".join(f"`{name}`:string" for name in LEGAL)
_RELATION = f"array<struct<relation:struct<`parent-doc`:struct<`document-id`:struct<{_DOC}>,`parent-status`:string>,`child-doc`:struct<`document-id`:struct<{_DOC}>>>>>"
_RELATED_FIELDS = ",".join(f"`{kind}`:{_RELATION}" for kind in RELATED)

PATENT_TAG = "bibliographic-data"
PATENT_SCHEMA = f"""
_lang string, `publication-reference` struct<`document-id`:struct<{_DOC}>>, `application-reference` struct<`document-id`:struct<{_DOC}>>,
`language-of-filing` string, `language-of-publication` string, `number-of-claims` int,
`invention-title` array<struct<_lang:string,_VALUE:string>>, abstract array<struct<_lang:string,p:array<string>>>,
`priority-claims` struct<`priority-claim`:array<struct<_sequence:int,_kind:string,country:string,`doc-number`:string,date:string>>>,
parties struct<applicants:struct<applicant:{_PARTY}>,inventors:struct<inventor:{_PARTY}>,agents:struct<agent:{_PARTY}>,examiners:struct<`primary-examiner`:struct<`last-name`:string,`first-name`:string,department:string>>>,
`references-cited` struct<citation:array<struct<patcit:struct<_num:int,`document-id`:array<struct<{_DOC}>>>,nplcit:struct<_num:string,text:string,`scopus-url`:string>>>>,
`legal-data` struct<`legal-event`:array<struct<_sequence:int,`publication-date`:struct<date:string>,`event-text`:string,{_LEGAL_FIELDS}>>>,
`related-documents` struct<{_RELATED_FIELDS},`provisional-application`:array<struct<`document-id`:struct<{_DOC}>>>,`related-publication`:array<struct<`document-id`:struct<{_DOC}>>>>,
`patent-family` struct<`main-family`:struct<_id:string,`family-member`:array<struct<`document-id`:struct<{_DOC}>>>>>
"""

_PUB = {"country_code": "`publication-reference`.`document-id`.country", "doc_number": "`publication-reference`.`document-id`.`doc-number`", "kind_code": "`publication-reference`.`document-id`.kind"}
_KEYS = tuple(_PUB)


def _day(text: str) -> str:
    return f"try_to_date({text}, 'yyyyMMdd')"


def _party(path: str, where: str | None = None) -> TableSpec:
    book = "get(r.addressbook, 0)"
    columns = {"sequence": "r._sequence", "language": f"{book}._lang", "name": f"coalesce({book}.name, {book}.orgname, concat_ws(', ', {book}.`last-name`, {book}.`first-name`))", "city": f"{book}.address.city", "country": f"{book}.address.country"}
    return TableSpec(path, _PUB | columns, (*_KEYS, "sequence"), where=where)


def _related(kind: str) -> TableSpec:
    parent, child = "r.relation.`parent-doc`.`document-id`", "r.relation.`child-doc`.`document-id`"
    return TableSpec(f"`related-documents`.`{kind}`", _PUB | {"relation": f"'{kind}'", "parent_country": f"{parent}.country", "parent_number": f"{parent}.`doc-number`", "parent_kind": f"{parent}.kind", "parent_date": _day(f"{parent}.date"), "parent_status": "r.relation.`parent-doc`.`parent-status`", "child_country": f"{child}.country", "child_number": f"{child}.`doc-number`"})


def _document(kind: str) -> TableSpec:
    return TableSpec(f"`related-documents`.`{kind}`", _PUB | {"related_country": "r.`document-id`.country", "related_number": "r.`document-id`.`doc-number`", "related_kind": "r.`document-id`.kind", "related_date": _day("r.`document-id`.date")})


PATENT_TABLES = {
    "patents": TableSpec("", _PUB | {"language_of_filing": "`language-of-filing`", "language_of_publication": "`language-of-publication`", "publication_date": _day("`publication-reference`.`document-id`.date"), "number_of_claims": "`number-of-claims`"}, _KEYS),
    "applications": TableSpec("", _PUB | {"appl_country": "`application-reference`.`document-id`.country", "appl_number": "`application-reference`.`document-id`.`doc-number`", "appl_date": _day("`application-reference`.`document-id`.date")}, _KEYS),
    "titles": TableSpec("`invention-title`", _PUB | {"language": "r._lang", "title": "trim(regexp_replace(r._VALUE, '\\\\s+', ' '))"}, (*_KEYS, "language")),
    "abstracts": TableSpec("abstract", _PUB | {"language": "r._lang", "abstract": "array_join(r.p, '\n')"}, (*_KEYS, "language")),
    "priority_claims": TableSpec("`priority-claims`.`priority-claim`", _PUB | {"sequence": "r._sequence", "priority_country": "r.country", "priority_number": "r.`doc-number`", "priority_kind": "r._kind", "priority_date": _day("r.date")}, (*_KEYS, "sequence")),
    "inventors": _party("parties.inventors.inventor", "r.`_data-format` IS NULL"),
    "applicants": _party("parties.applicants.applicant"),
    "agents": _party("parties.agents.agent"),
    "examiners": TableSpec("", _PUB | {"last_name": "parties.examiners.`primary-examiner`.`last-name`", "first_name": "parties.examiners.`primary-examiner`.`first-name`", "department": "parties.examiners.`primary-examiner`.department"}, _KEYS, where="parties.examiners.`primary-examiner` IS NOT NULL"),
    "patent_citations": TableSpec("`references-cited`.citation", _PUB | {"seq_num": "r.patcit._num", "cited_country": "get(r.patcit.`document-id`, 0).country", "cited_number": "get(r.patcit.`document-id`, 0).`doc-number`", "cited_kind": "get(r.patcit.`document-id`, 0).kind", "cited_date": _day("get(r.patcit.`document-id`, 0).date")}, (*_KEYS, "seq_num"), where="r.patcit IS NOT NULL"),
    "nonpatent_citations": TableSpec("`references-cited`.citation", _PUB | {"citation_number": "r.nplcit._num", "citation_text": "r.nplcit.text", "url": "r.nplcit.`scopus-url`"}, (*_KEYS, "citation_number"), where="r.nplcit IS NOT NULL"),
    "legal_events": TableSpec("`legal-data`.`legal-event`", _PUB | {"sequence": "r._sequence", "event_date": _day("r.`publication-date`.date"), "event_text": "r.`event-text`", **{name.replace("-", "_"): f"r.`{name}`" for name in LEGAL}}, (*_KEYS, "sequence")),
    "family": TableSpec("`patent-family`.`main-family`.`family-member`", _PUB | {"family_id": "`patent-family`.`main-family`._id", "member_country": "r.`document-id`.country", "member_number": "r.`document-id`.`doc-number`", "member_kind": "r.`document-id`.kind"}, (*_KEYS, "family_id", "member_country", "member_number", "member_kind")),
    **{f"related_{kind.replace('-', '_')}": _related(kind) for kind in RELATED},
    "related_provisional_application": _document("provisional-application"),
    "related_publication": _document("related-publication"),
    "us_agents": _party("parties.agents.agent", "`publication-reference`.`document-id`.country = 'US'"),
    "ep_agents": _party("parties.agents.agent", "`publication-reference`.`document-id`.country = 'EP'"),
}

_PERSON = "struct<first_name:string,middle_name:string,last_name:string,degrees:string,role:string,affiliation:string,phone:string,email:string>"
_PLACE = "struct<name:string,address:struct<city:string,state:string,zip:string,country:string>>"

TRIAL_TAG = "clinical_study"
TRIAL_SCHEMA = f"""
_rank int, required_header struct<download_date:string,link_text:string,url:string>, id_info struct<org_study_id:string,secondary_id:array<string>,nct_id:string,nct_alias:array<string>>,
brief_title string, official_title string, acronym string, source string, sponsors struct<lead_sponsor:struct<agency:string,agency_class:string>,collaborator:array<struct<agency:string,agency_class:string>>>,
overall_status string, why_stopped string, start_date string, completion_date struct<_type:string,_VALUE:string>, phase string, study_type string, enrollment struct<_type:string,_VALUE:string>,
study_design_info struct<allocation:string,intervention_model:string,primary_purpose:string,observational_model:string,time_perspective:string,masking:string>, expanded_access_info struct<expanded_access_type_individual:string,expanded_access_type_intermediate:string,expanded_access_type_treatment:string>,
primary_outcome array<struct<measure:string,time_frame:string,description:string>>, secondary_outcome array<struct<measure:string,time_frame:string,description:string>>,
condition array<string>, keyword array<string>, arm_group array<struct<arm_group_label:string,arm_group_type:string,description:string>>,
intervention array<struct<intervention_type:string,intervention_name:string,description:string,arm_group_label:array<string>,other_name:array<string>>>,
overall_official array<{_PERSON}>, overall_contact {_PERSON}, location array<struct<facility:{_PLACE},status:string,contact:{_PERSON},investigator:array<{_PERSON}>>>,
location_countries struct<country:array<string>>, link array<struct<url:string,description:string>>, reference array<struct<citation:string,PMID:string>>, results_reference array<struct<citation:string,PMID:string>>,
condition_browse struct<mesh_term:array<string>>, intervention_browse struct<mesh_term:array<string>>
"""

_NCT = {"nct_id": "trim(id_info.nct_id)"}


def _trial(path: str, columns: dict[str, str], where: str | None = None) -> TableSpec:
    return TableSpec(path, _NCT | columns, where=where)


TRIAL_TABLES = {
    "studies": TableSpec("", _NCT | {"rank": "_rank", "download_date": "required_header.download_date", "org_study_id": "id_info.org_study_id", "brief_title": "trim(brief_title)", "official_title": "trim(official_title)", "lead_sponsor_agency": "sponsors.lead_sponsor.agency", "overall_status": "overall_status", "start_date": "start_date", "completion_date": "completion_date._VALUE", "completion_date_type": "completion_date._type", "phase": "phase", "study_type": "study_type", "enrollment": "enrollment._VALUE"}, ("nct_id",)),
    "study_design_info": _trial("", {"allocation": "study_design_info.allocation", "intervention_model": "study_design_info.intervention_model", "primary_purpose": "study_design_info.primary_purpose", "masking": "study_design_info.masking"}, "study_design_info IS NOT NULL"),
    "expanded_access_info": _trial("", {"individual": "expanded_access_info.expanded_access_type_individual", "intermediate": "expanded_access_info.expanded_access_type_intermediate", "treatment": "expanded_access_info.expanded_access_type_treatment"}, "expanded_access_info IS NOT NULL"),
    "secondary_ids": _trial("id_info.secondary_id", {"secondary_id": "r"}),
    "collaborators": _trial("sponsors.collaborator", {"agency": "r.agency", "agency_class": "r.agency_class"}),
    "primary_outcomes": _trial("primary_outcome", {"outcome_type": "'primary'", "measure": "r.measure", "time_frame": "r.time_frame", "description": "r.description"}),
    "secondary_outcomes": _trial("secondary_outcome", {"outcome_type": "'secondary'", "measure": "r.measure", "time_frame": "r.time_frame", "description": "r.description"}),
    "conditions": _trial("condition", {"condition": "trim(r)"}),
    "keywords": _trial("keyword", {"keyword": "trim(r)"}),
    "arm_groups": _trial("arm_group", {"arm_group_label": "r.arm_group_label", "arm_group_type": "r.arm_group_type", "description": "r.description"}),
    "interventions": _trial("intervention", {"intervention_no": "pos", "intervention_type": "r.intervention_type", "intervention_name": "r.intervention_name", "description": "r.description"}),
    "intervention_arm_group_labels": _trial("intervention", {"intervention_name": "r.intervention_name", "arm_group_label": "explode(r.arm_group_label)"}),
    "intervention_other_names": _trial("intervention", {"intervention_name": "r.intervention_name", "other_name": "explode(r.other_name)"}),
    "overall_officials": _trial("overall_official", {"first_name": "r.first_name", "middle_name": "r.middle_name", "last_name": "r.last_name", "degrees": "r.degrees", "role": "r.role", "affiliation": "r.affiliation"}),
    "overall_contacts": _trial("", {"last_name": "overall_contact.last_name", "phone": "overall_contact.phone", "email": "overall_contact.email"}, "overall_contact IS NOT NULL"),
    "locations": _trial("location", {"location_no": "pos", "facility_name": "r.facility.name", "city": "r.facility.address.city", "country": "r.facility.address.country", "status": "r.status"}),
    "location_investigators": _trial("location/investigator", {"first_name": "r.first_name", "last_name": "r.last_name", "role": "r.role"}),
    "location_countries": _trial("location_countries.country", {"country": "r"}),
    "links": _trial("link", {"url": "r.url", "description": "r.description"}),
    "references": _trial("reference", {"citation": "r.citation", "pmid": "r.PMID", "citation_key": "md5(r.citation)"}),
    "publications": _trial("results_reference", {"citation": "r.citation", "pmid": "r.PMID"}),
    "condition_browses": _trial("condition_browse.mesh_term", {"mesh_term": "r"}),
    "intervention_browses": _trial("intervention_browse.mesh_term", {"mesh_term": "r"}),
}

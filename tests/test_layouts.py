from __future__ import annotations

import datetime

from citeloom.sources import layouts as L
from citeloom.sources.xmlrows import read_xml, shred

PUBLICATION = """<items><item><bibrecord>
<item-info><itemidlist><itemid idtype="SCP">11</itemid><itemid idtype="SGR">11</itemid><ce:doi xmlns:ce="u">10.1/x</ce:doi></itemidlist></item-info>
<head><source srcid="s1" type="j"><sourcetitle>J</sourcetitle><issn type="print">1234</issn><publicationyear first="2001"/></source>
<citation-info><citation-type code="ar"/><citation-language language="ENG"/><author-keywords><author-keyword>k1</author-keyword><author-keyword>k1</author-keyword><author-keyword>k2</author-keyword></author-keywords></citation-info>
<citation-title><titletext language="eng">A  title
 here</titletext></citation-title>
<author-group><author seq="1" auid="5"><ce:surname xmlns:ce="u">Doe</ce:surname></author><author seq="2" auid="6"/><affiliation afid="9"><organization>Dept</organization><organization>Uni</organization><city>C</city></affiliation></author-group>
<grantlist><grant><grant-agency iso-code="USA">NIH</grant-agency></grant></grantlist>
<enhancement><classificationgroup><classifications type="ASJC"><classification>1701;1702</classification><classification>17</classification></classifications></classificationgroup></enhancement>
</head>
<tail><bibliography><reference id="1"><ref-info><refd-itemidlist><itemid idtype="SGR">20</itemid></refd-itemidlist><ref-text>r</ref-text></ref-info></reference>
<reference id="2"><ref-fulltext>self</ref-fulltext><ref-info><refd-itemidlist><itemid idtype="SGR">11</itemid></refd-itemidlist></ref-info></reference></bibliography></tail>
</bibrecord></item></items>"""

PATENT = """<docs><bibliographic-data><publication-reference><document-id><country>US</country><doc-number>7</doc-number><kind>A1</kind><date>20010203</date></document-id></publication-reference>
<invention-title lang="eng">T</invention-title>
<parties><inventors><inventor sequence="1"><addressbook lang="eng"><last-name>Doe</last-name><first-name>Ann</first-name></addressbook></inventor><inventor sequence="1" data-format="x"><addressbook><name>other</name></addressbook></inventor></inventors></parties>
<references-cited><citation><patcit num="1"><document-id><country>EP</country><doc-number>3</doc-number><date>19990230</date></document-id></patcit></citation><citation><nplcit num="2"><text>paper</text></nplcit></citation></references-cited>
</bibliographic-data></docs>"""

TRIAL = """<all><clinical_study rank="3"><id_info><org_study_id>o</org_study_id><nct_id> NCT1 </nct_id></id_info><brief_title>b</brief_title><completion_date type="Actual">May 2001</completion_date>
<condition>c1</condition><condition>c2</condition><intervention><intervention_name>i1</intervention_name><arm_group_label>a</arm_group_label><arm_group_label>b</arm_group_label></intervention><intervention><intervention_name>i2</intervention_name></intervention>
<location><facility><name>f</name></facility><investigator><last_name>Doe</last_name></investigator><investigator><last_name>Roe</last_name></investigator></location></clinical_study></all>"""


def tables(spark, tmp_path, text, tag, schema, spec):
    (tmp_path / "d.xml").write_text(text)
    return shred(read_xml(spark, str(tmp_path / "d.xml"), tag, schema), spec)


def test_publications(spark, rows, tmp_path):
    t = tables(spark, tmp_path, PUBLICATION, L.PUBLICATION_TAG, L.PUBLICATION_SCHEMA, L.PUBLICATION_TABLES)
    assert rows(t["publications"]) == [(11, 11, 2001, "ar", "ENG", "s1")]
    assert rows(t["authors"].select("scp", "author_seq", "auid", "surname")) == [(11, 1, 5, "Doe"), (11, 2, 6, None)]
    assert rows(t["affiliations"].select("scp", "affiliation_no", "afid", "organization")) == [(11, 1, 9, "Dept, Uni")]
    assert rows(t["titles"]) == [(11, "eng", "A title here")]
    assert rows(t["keywords"]) == [(11, "k1"), (11, "k2")]
    assert rows(t["identifiers"]) == [(11, "11", "SCP"), (11, "11", "SGR")]
    assert rows(t["dois"]) == [(11, "10.1/x", "DOI")]
    assert rows(t["grants"].select("grant_id", "grantor", "country_code")) == [("", "NIH", "USA")]
    assert rows(t["classes"]) == [(11, "ASJC", "1701")]
    assert rows(t["publication_groups"]) == [(11, 2001)] and rows(t["issns"]) == [("s1", "1234", "print")]
    assert rows(t["author_affiliations"]) == [(11, 1, 1), (11, 1, 2)]
    assert rows(t["conference_events"]) == rows(t["isbns"]) == []
    assert rows(t["references"]) == [(11, 20, "r")]
    assert rows(t["sources"]) == [("s1", "j", "J", "1234", None, None, None, None)]
    for name in ("abstracts", "piis", "acknowledgments", "chemicals"):
        assert rows(t[name]) == []


def test_patents(spark, rows, tmp_path):
    t = tables(spark, tmp_path, PATENT, L.PATENT_TAG, L.PATENT_SCHEMA, L.PATENT_TABLES)
    assert rows(t["patents"].select("country_code", "doc_number", "kind_code", "publication_date")) == [("US", "7", "A1", datetime.date(2001, 2, 3))]
    assert rows(t["inventors"].select("sequence", "name")) == [(1, "Doe, Ann")]
    assert rows(t["patent_citations"].select("seq_num", "cited_number", "cited_date")) == [(1, "3", None)]
    assert rows(t["nonpatent_citations"].select("citation_number", "citation_text")) == [("2", "paper")]
    for name in set(L.PATENT_TABLES) - {"patents", "inventors", "patent_citations", "nonpatent_citations", "titles", "applications"}:
        assert rows(t[name]) == [], name


def test_trials(spark, rows, tmp_path):
    t = tables(spark, tmp_path, TRIAL, L.TRIAL_TAG, L.TRIAL_SCHEMA, L.TRIAL_TABLES)
    assert rows(t["studies"].select("nct_id", "rank", "completion_date", "completion_date_type")) == [("NCT1", 3, "May 2001", "Actual")]
    assert rows(t["conditions"]) == [("NCT1", "c1"), ("NCT1", "c2")]
    assert rows(t["intervention_arm_group_labels"]) == [("NCT1", "i1", "a"), ("NCT1", "i1", "b")]
    assert rows(t["location_investigators"].select("last_name")) == [("Doe",), ("Roe",)]
    assert rows(t["interventions"].select("intervention_no", "intervention_name")) == [(1, "i1"), (2, "i2")]
    for name in set(L.TRIAL_TABLES):
        t[name].collect()


PROCEEDINGS = """<items><item><bibrecord><item-info><itemidlist><itemid idtype="SCP">12</itemid><itemid idtype="SGR">13</itemid></itemidlist></item-info>
<head><correspondence><affiliation><organization>Dept</organization><organization>Uni</organization></affiliation></correspondence>
<author-group><author seq="1"/><affiliation afid="8"/></author-group><author-group><author seq="1"/><author seq="2"/><affiliation afid="9"/></author-group>
<source srcid="p1" type="p"><sourcetitle>Proc</sourcetitle><codencode>PRC</codencode><isbn type="print" length="13" level="set">978</isbn><isbn>979</isbn><volisspag><voliss volume="4" issue="2"/><pagerange first="10" last="19"/></volisspag>
<publicationyear first="2010"/><publicationdate><year>2010</year><month>2</month></publicationdate><publisher><publishername>Pub</publishername></publisher>
<additional-srcinfo><conferenceinfo><confevent><confname>Big
 Meeting</confname><confnumber>3</confnumber><conflocation><city>Town</city></conflocation><confdate><startdate year="2010" month="2" day="30"/><enddate year="2010" month="3" day="2"/></confdate><confcode>77</confcode><confsponsors><confsponsor>A</confsponsor><confsponsor>B</confsponsor></confsponsors></confevent>
<confpublication><procpartno>1</procpartno><procpagecount>123p.</procpagecount><confeditors><editors><editor><ce:indexed-name xmlns:ce="u">Doe A.</ce:indexed-name><ce:surname xmlns:ce="u">Doe</ce:surname></editor></editors><editoraddress>Street</editoraddress></confeditors></confpublication></conferenceinfo></additional-srcinfo></source>
<enhancement><descriptorgroup><descriptors><descriptor><mainterm>t 1</mainterm></descriptor><descriptor><mainterm>t 2</mainterm></descriptor></descriptors></descriptorgroup>
<classificationgroup><classifications type="SUBJABBR"><classification>MEDI</classification></classifications><classifications type="SUBJECT"><classification>Medicine</classification></classifications></classificationgroup></enhancement></head></bibrecord></item></items>"""


def test_proceedings(spark, rows, tmp_path):
    t = tables(spark, tmp_path, PROCEEDINGS, L.PUBLICATION_TAG, L.PUBLICATION_SCHEMA, L.PUBLICATION_TABLES)
    assert rows(t["isbns"]) == sorted([("p1", "978", 13, "print", "set"), ("p1", "979", None, None, None)], key=repr)
    assert rows(t["publication_details"]) == [(12, "2", "4", "10", "19", 2010, datetime.date(2010, 2, 1), "77", "Big Meeting")]
    assert rows(t["conference_events"]) == [("77", "Big Meeting", None, "Town", None, None, datetime.date(2010, 3, 2), "3", None, "A,B")]
    assert rows(t["conference_proceedings"]) == [("p1", "77", "Big Meeting", "1", None, 123)]
    assert rows(t["conference_editors"].select("indexed_name", "surname", "address")) == [("Doe A.", "Doe", "Street")]
    assert rows(t["author_affiliations"]) == [(12, 1, 1), (12, 2, 1), (12, 2, 2)]
    assert (rows(t["indexed_terms"]), rows(t["subjects"]), rows(t["subject_keywords"]), rows(t["classes"])) == ([(12, "t 1"), (12, "t 2")], [(12, "MEDI")], [(12, "Medicine")], [])
    assert rows(t["corresponding_organizations"]) == [(12, "Dept, Uni")]
    assert rows(t["sources"].select("coden_code", "publisher_name")) == [("PRC", "Pub")]


RELATED = """<docs><bibliographic-data><publication-reference><document-id><country>US</country><doc-number>7</doc-number><kind>B2</kind></document-id></publication-reference>
<parties><agents><agent sequence="1"><addressbook><name>Law</name></addressbook></agent></agents></parties>
<legal-data><legal-event sequence="1"><publication-date><date>20010203</date></publication-date><event-code-1>E1</event-code-1><new-owner>Own</new-owner><withdrawn-date>20020101</withdrawn-date></legal-event></legal-data>
<related-documents><reissue><relation><parent-doc><document-id><country>US</country><doc-number>5</doc-number></document-id><parent-status>GRANTED</parent-status></parent-doc><child-doc><document-id><doc-number>7</doc-number></document-id></child-doc></relation></reissue>
<provisional-application><document-id><country>US</country><doc-number>60</doc-number><date>20000102</date></document-id></provisional-application></related-documents></bibliographic-data></docs>"""


def test_related_patents(spark, rows, tmp_path):
    t = tables(spark, tmp_path, RELATED, L.PATENT_TAG, L.PATENT_SCHEMA, L.PATENT_TABLES)
    assert len([n for n in t if n.startswith("related_")]) == 14
    assert rows(t["related_reissue"].select("relation", "parent_number", "parent_status", "child_number")) == [("reissue", "5", "GRANTED", "7")]
    assert rows(t["related_provisional_application"].select("related_number", "related_date")) == [("60", datetime.date(2000, 1, 2))]
    assert rows(t["legal_events"].select("event_code_1", "new_owner", "withdrawn_date", "event_date")) == [("E1", "Own", "20020101", datetime.date(2001, 2, 3))]
    assert rows(t["us_agents"].select("name")) == [("Law",)] and rows(t["ep_agents"]) == []

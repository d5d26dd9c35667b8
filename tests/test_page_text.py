"""Documents written for whole batches: odd rows, and no lambda for each region in the plan."""

from foliospark import annotations as an

ODD = """
    (1, 'a&b<c>"d".jpg', 10, 20, NULL, NULL, NULL, NULL, NULL, NULL),
    (2, NULL, 10, 20, array(), array(), array(), array(), array(), NULL),
    (3, 'c.jpg', NULL, 20, array(), NULL, NULL, NULL, NULL, NULL),
    (4, 'd.jpg', 1, 2,
     array(NULL, named_struct('id', 'é&', 'coords', array(named_struct('x', 1, 'y', CAST(NULL AS INT)), NULL, named_struct('x', -3, 'y', 4)), 'custom_attribute', '', 'type', CAST(NULL AS STRING), 'text_equiv', '<',
       'text_lines', array(NULL, named_struct('id', 't', 'coords', NULL, 'custom_attribute', NULL, 'baseline', array(named_struct('x', 5, 'y', 6)), 'text', NULL)))),
     array(named_struct('id', 'g', 'coords', array(), 'custom_attribute', 'x')), array(NULL),
     array(named_struct('id', 'k', 'coords', NULL, 'custom_attribute', NULL, 'rows', 2, 'columns', NULL, 'cells',
       array(NULL, named_struct('id', 'c', 'coords', array(), 'custom_attribute', '', 'row_index', 0, 'col_index', 1, 'row_span', NULL, 'col_span', 2, 'header', true, 'embedded_text', false)))),
     array(named_struct('x', 0, 'y', 0)), named_struct('creator', 'me', 'created', '1999', 'last_change', NULL, 'comments', 'a>b;'))
"""


def odd_pages(spark):
    names = an.JSON_SCHEMA
    raw = spark.sql(f"SELECT * FROM VALUES {ODD} AS t(key, image_filename, image_width, image_height, text_regions, graphic_regions, separator_regions, table_regions, page_border, metadata)")
    return spark.createDataFrame(raw.rdd, f"key int, {names}")


def test_odd_documents(spark):
    pages = odd_pages(spark)
    head = f'<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="{an.NAMESPACE}"><Metadata><Creator>you</Creator>'
    got = dict(pages.select("key", an.page_xml("you", "2020", pages.schema, "!").alias("xml")).collect())
    assert got[1] == head + '<Created>2020</Created><Comments>!</Comments></Metadata><Page imageFilename="a&amp;b&lt;c&gt;&quot;d&quot;.jpg" imageWidth="10" imageHeight="20"></Page></PcGts>'
    assert got[2] is None and got[3] is None
    line = '<TextLine><TextEquiv><Unicode></Unicode></TextEquiv></TextLine><TextLine id="t"><Baseline points="5,6"/><TextEquiv><Unicode></Unicode></TextEquiv></TextLine>'
    assert got[4] == head + (
        '<Created>1999</Created><LastChange>2020</LastChange><Comments>a&gt;b;!</Comments></Metadata><Page imageFilename="d.jpg" imageWidth="1" imageHeight="2"><Border><Coords points="0,0"/></Border>'
        f'<TextRegion></TextRegion><TextRegion id="é&amp;"><Coords points="1  -3,4"/>{line}<TextEquiv><Unicode>&lt;</Unicode></TextEquiv></TextRegion>'
        '<GraphicRegion id="g" custom="x"></GraphicRegion><SeparatorRegion></SeparatorRegion>'
        '<TableRegion id="k" rows="2"><TableCell></TableCell><TableCell id="c" rowIndex="0" columnIndex="1" colSpan="2" header="true" embText="false"></TableCell></TableRegion></Page></PcGts>'
    )
    assert spark.createDataFrame([], pages.schema).select(an.page_xml("you", "2020", pages.schema)).collect() == []


def test_documents_are_written_in_batches(spark):
    """A lambda for each region and corner is interpreted: at 24 times sf0.1 that took three fifths of page_xml_regions."""
    pages = odd_pages(spark)
    plan = pages.select(an.page_xml("you", "2020", pages.schema).alias("xml"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
